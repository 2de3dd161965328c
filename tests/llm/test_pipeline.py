import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

from . import brute
from .test_models_shards import toxic_rows


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, labels = toxic_rows(700, 1)
    rnd = random.Random(9)
    long_words = [f"w{i}x" for i in range(3000)]
    fresh = lambda n: " ".join(rnd.choice(long_words) for _ in range(n))
    item, passage = fresh(14), fresh(60)
    extra = [(10 + i, fresh(120)) for i in range(20)]
    extra += [(200, extra[0][1]), (201, extra[1][1] + " more"), (202, f"{fresh(40)} {passage} {fresh(40)}"), (203, f"{fresh(30)} {passage} {fresh(50)}"), (204, f"{fresh(50)} {item} {fresh(30)}"), (205, "x"), (206, ""), (207, None), (208, "tail é " * 3)]
    rows = [(k, x, "en", "s", len(x or "")) for k, x in docs + extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    toxic = {k for k, y in labels if y}
    left = {k: x for k, x in docs + extra if k not in toxic}
    near = brute.near(list(left.items()))
    left = {k: x for k, x in left.items() if near[k][2]}
    cut = brute.suffix(list(left.items()))
    left = {k: cut[k][3].decode("utf-8", errors="ignore") for k in left}
    hits = brute.contamination(list(left.items()), [(1, item)])
    left = {k: x for k, x in left.items() if not hits[k][4]}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for k, x in left.items():
        ids = lib.encode(x, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert found == want
    assert 200 not in found and 201 not in found and 204 not in found and passage not in " ".join(left.values())


def test_rows_are_neither_lost_nor_mixed(spark, tmp_path):
    """Rows without a doc_id, rows that share one, repeated rows and a dotted column, through every stage."""
    docs, labels = toxic_rows(300, 4)
    rnd = random.Random(10)
    fresh = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}x" for _ in range(n))
    passage, item, copied = fresh(60), fresh(12), fresh(100)
    extra = [(None, fresh(80)), (None, f"{fresh(30)} {passage} {fresh(30)}"), (None, copied), (5, copied), (5, fresh(90)), (5, f"{fresh(20)} {passage} {fresh(50)}"), (6, fresh(70)), (6, f"{fresh(30)} {item}"), (7, ""), (7, None), (8, "long " + fresh(40_000))]
    extra += [extra[0], extra[4], extra[8]]
    rows = [(k, x, len(x or ""), f"é{i}") for i, (k, x) in enumerate(docs + extra)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, "no words like these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "bpe" or at.columns == columns
        seen[name] = at
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    plain = lambda rows: sorted((k is None, k or 0, x or "") for k, x in rows)
    toxic = {k for k, y in labels if y}
    left = [(k, x) for k, x in docs if k not in toxic]
    assert sorted(map(key, seen["toxicity"].collect())) == plain(left + extra)
    once = [r for r in dict.fromkeys(extra) if r != (None, copied)]
    once.remove((7, None))  # a text without words stays once for each doc_id and text; null and empty are two
    found = sorted(map(key, seen["near_duplicates"].collect()))
    near = brute.near(left)
    assert found == plain([r for r in left if near[r[0]][2]] + once + [(7, None)])
    texts = {r.text for r in seen["suffix_array_dedup"].where("doc_id is null or doc_id < 10").collect()}
    assert not any(passage in (x or "") for x in texts) and {x for _, x in once if passage not in (x or "")} <= texts
    assert seen["suffix_array_dedup"].count() == len(found)
    assert seen["decontamination"].count() == len(found) - 1 and seen["bpe"].count() == len(found) - 1


def test_second_stage_keeps_clean_rows_without_ids(spark, tmp_path):
    rnd = random.Random(5)
    fresh = lambda: " ".join(f"w{rnd.randint(0, 10**6)}x" for _ in range(80))
    texts = [fresh() for _ in range(6)]
    rows = [(None, x, "en") for x in texts[:4]] + [(None, texts[0], "en"), (7, texts[1] + " more", "en"), (8, texts[4], "en"), (9, texts[5], "en"), (9, texts[5], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [rows[0], *rows[2:4], *rows[5:8]]))  # a row with a doc_id stands before one without


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and {"pipeline", *(n for n in __spark_entry__.queries() if n.startswith("op7_"))} <= set(__spark_entry__.queries())

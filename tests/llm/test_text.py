import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gristmill.llm import bpe, decontam, token_output

from . import brute


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    alphabet = "ab stdmrevl'  \n\t\x0b'''ABÉéçñß0123456789.,!?-_\x85\xa0\x1c\x00<|¼²ªœÆ日٣"
    out = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    return out + [(400, None), (401, ""), (402, "it's 'tis we'll they'reX 've'd''s"), (403, "<|endoftext|>x"), (404, "x" * 5000), (405, "don't  stop\n\n now  "), (405, "don't  stop\n\n now  "), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 as n_tokens", "'' as ids").repartition(3)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_bpe_round_trip(spark, rows):
    lib, texts = library("word_bpe_49k.json"), dict(rows)
    found = bpe.round_trip(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), texts[r.doc_id]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, rows))).collect()}
    assert back[402] == lib.decode(lib.encode(texts[402], add_special_tokens=False).ids, skip_special_tokens=False)


def test_forced_boundaries_change_nothing():
    lib, own = library("word_bpe_49k.json"), bpe.encoder(public_tokenizers.path("word_bpe_49k.json"))[0]
    rnd = random.Random(2)
    cut = 0
    for _ in range(500):
        word = "".join(rnd.choice("qzxjvkabceth") for _ in range(rnd.randint(1, 70)))
        cut += len(own.fragments(word.encode())) > 1
        assert own.encode_word(word.encode()) == lib.encode(word, add_special_tokens=False).ids
        assert b"".join(p for p, _ in own.fragments(word.encode())) == word.encode()
    assert cut > 50


def test_token_files(spark, rows, tmp_path):
    lib = library("byte_bpe_50k.json")
    folder = token_output.write_dataset(frame(spark, rows), f"file://{tmp_path}/tokens", parts=3)
    found = token_output.read_dataset(spark, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for k, x in order:
        ids = [*lib.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, found), key=key) == want
    assert not [p for p in (tmp_path / "tokens").iterdir() if not p.name.endswith((".bin", ".json"))]


@pytest.mark.parametrize("operator", [bpe.round_trip, lambda d: token_output.read_dataset(d.sparkSession, token_output.write_dataset(d))])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1 << 25, 60])
def test_contamination(spark, parts, monkeypatch):
    if parts > 60:
        monkeypatch.setattr(decontam, "PART", 50)
    rnd = random.Random(5)
    vocabulary = ["Alpha", "beta", "GAMMA", "delta9", "é", "42", "zeta"]
    items = [(1, " ".join(rnd.choice(vocabulary) for _ in range(14))), (2, "beta, beta; BETA"), (10, None), (11, ""), (12, "...")]
    items += [items[0], (3, items[0][1]), (2, "alpha gamma"), (None, "delta9 zeta"), (None, "beta beta beta")]
    rows = [(i, rnd.choice(["", "-", "x "]).join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    rows += [(100, f"start {items[0][1].lower()} end"), (101, None), (102, "beta-beta.beta/beta"), (103, "BETA BETA BETA")]
    rows += [(104, " ".join(rnd.choice(vocabulary) for _ in range(4000))), rows[3], rows[61]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as items", "1 as spans", "2 as `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(docs, bench, automaton_bytes=parts)
    assert found.count() == len(rows)
    want = brute.contamination(rows, items)
    for r in decontam.digest(found).collect():
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    for r in found.collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        for s in r.spans:
            assert len(decontam.words_of(raw[s.start_byte : s.end_byte])) == s.end_word - s.start_word
    left = decontam.clean(docs, bench, automaton_bytes=parts)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert kept == {k for k, w in want.items() if not w[4]}
    assert decontam.digest(decontam.find_contamination(docs, bench.limit(0))).where("contaminated").count() == 0

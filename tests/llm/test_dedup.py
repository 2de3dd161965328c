import random

import pytest

from gristmill.llm import anchors, minhash, substring_dedup, suffix_dedup
from gristmill.llm.components import connected_components
from gristmill.llm.fm_index import FMIndex
from gristmill.llm.suffix_levels import SuffixFamily

from . import brute


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(None, "w " * 60)]
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(300, 800))) for _ in range(5)]
    for i in range(120):
        a, b = rnd.choice(base), rnd.choice(base)
        out.append((i, a[: rnd.randint(0, len(a))] + rnd.choice(["", f" X{i} "]) + b[rnd.randint(0, len(b)) :]))
    out += [(1000, None), (1001, ""), (1002, "a " * 300), (1003, "b" * 700), (1004, "c" * 150), (1005, base[0] * 3), (1006, base[1]), (1007, base[1]), (1006, base[1])]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as kept", "1 as spans", "2 as n").repartition(5)


@pytest.mark.parametrize("hot", [2000, 3])
def test_substrings(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_CLASSES", hot)
    found = substring_dedup.remove_repeats(frame(spark, rows), digest=True).collect()
    want = brute.substring(rows)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("hot", [2000, 3])
def test_suffixes(spark, rows, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_CLASSES", hot)
    found = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    want = brute.suffix(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("hot", [2000, 3])
def test_repeated_rows_count_once(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_CLASSES", hot)
    rnd = random.Random(8)
    fresh = lambda n: " ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(n))
    passage = fresh(60)
    rows = [(i, f"{fresh(20)} {passage} {fresh(90)}") for i in range(12)]
    rows += rows[:8] * 2
    want = brute.substring(rows)
    for r in substring_dedup.remove_repeats(frame(spark, rows), digest=True).collect():
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id
    want = brute.suffix(rows)
    for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_rows_without_ids_are_told_apart(spark):
    rnd = random.Random(12)
    fresh = lambda n: " ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(n))
    passage, same = fresh(50), fresh(80)
    texts = [f"{fresh(rnd.randint(10, 60))} {passage} {fresh(70)}" for _ in range(4)] + [fresh(100), fresh(110), same, same, "", None]
    rows = [(None, x) for x in texts] + [(1, same), (2, f"{passage} {fresh(30)}"), (-(1 << 63) + 5, fresh(60))]
    keys = {r.text: r.key for r in frame(spark, rows[: len(texts)]).select("text", anchors.row_key().alias("key")).collect()}
    named = [(keys[x] if k is None else k, x) for k, x in rows]
    assert len({k for k, _ in named}) == len(set(named))

    def right(found, want, of):
        got = sorted(repr(of(r)) for r in found.collect())
        assert got == sorted(repr((k, *want[n])) for (k, _), (n, _) in zip(rows, named, strict=True))

    right(substring_dedup.remove_repeats(frame(spark, rows), digest=True), brute.substring(named), tuple)
    right(suffix_dedup.remove_repeats(frame(spark, rows)), brute.suffix(named), lambda r: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    shown = {k: (n, None if c in keys.values() else c, kept) for k, (n, c, kept) in brute.near(named).items()}
    shown |= {keys[same]: (76, 1, False), 1: (76, 1, True)}  # rows without a doc_id sort last
    right(minhash.near_duplicates(frame(spark, rows)), shown, tuple)
    left = [(r.doc_id, r.text) for r in minhash.clean(frame(spark, rows)).collect()]
    assert sorted(left, key=repr) == sorted(((k, x) for k, x in {*rows} if (k, x) != (None, same)), key=repr)
    cut = brute.suffix(named)
    rewritten = suffix_dedup.rewrite(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in rewritten) == sorted((repr(k), cut[n][3].decode("utf-8", errors="ignore")) for (k, _), (n, _) in zip(rows, named, strict=True))


def test_rows_that_share_an_id_are_told_apart(spark):
    rnd = random.Random(15)
    fresh = lambda n: " ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(n))
    passage, copied = fresh(50), fresh(90)
    rows = [(5, f"{fresh(30)} {passage} {fresh(40)}"), (5, fresh(100)), (5, f"{passage} {fresh(10)}"), (5, copied), (6, copied), (6, fresh(70)), (7, "")]
    by_key = dict(enumerate(sorted(rows, key=lambda r: r[0])))  # the operators order rows of one id by a hash
    frame_ = frame(spark, rows)
    cut = brute.suffix([(k, x) for k, (_, x) in by_key.items()])
    found = sorted((r.doc_id, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame_).collect())
    assert found == sorted((by_key[k][0], v[3]) for k, v in cut.items())
    rewritten = sorted((r.doc_id, r.text) for r in suffix_dedup.rewrite(frame_).collect())
    assert rewritten == [(k, x.decode()) for k, x in found]
    removed = {r.doc_id: 0 for r in frame_.collect()}
    for r in substring_dedup.remove_repeats(frame_).collect():
        removed[r.doc_id] += r.n_removed
    assert removed == {5: 50, 6: 90, 7: 0}
    assert sorted((r.doc_id, r.text) for r in minhash.clean(frame_).collect()) == sorted(r for r in rows if r != (6, copied))


@pytest.mark.parametrize("common", [18, 19])
def test_a_common_run_below_the_threshold(spark, monkeypatch, common):
    """Many documents share a run just too short to count: nothing goes, and no shard holds them all."""
    monkeypatch.setattr(anchors, "HOT_CLASSES", 20)
    rnd = random.Random(16)
    fresh = lambda n: " ".join(f"{rnd.choice('abcdef')}{rnd.randint(0, 10**6)}" for _ in range(n))
    run = fresh(common)
    rows = [(i, f"{fresh(12)} {run} {fresh(12)}") for i in range(300)]
    docs = anchors.documents_of(frame(spark, rows))
    w = substring_dedup.WORDS
    found = anchors.decide(anchors.scan(docs.drop("missing"), w), w, 4).cache()
    assert anchors.fetch(anchors.pack(docs), found, w).where("piece is not null").groupBy("shard").count().where("count > 20").isEmpty()
    assert {r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {0}


def test_rewritten_texts_keep_columns(spark, rows):
    docs = frame(spark, rows).selectExpr("doc_id", "kept", "text", "cast(length(text) as long) as n_chars")
    out = suffix_dedup.rewrite(docs)
    want = brute.suffix(rows)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == want[r.doc_id][3].decode("utf-8", errors="ignore") and r.n_chars == len(r.text) and r.kept == "x"


@pytest.mark.parametrize("small_cells", [False, True])
def test_near_duplicates(spark, monkeypatch, small_cells):
    rnd = random.Random(4)
    base = [[f"{rnd.choice('abcdefgh')}{rnd.randint(0, 40)}" for _ in range(rnd.randint(40, 150))] for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a  B"), (5, "b a"), (6, " \t"), (7, "one two three four five")]
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, len(w) // 14)):
            w[rnd.randrange(len(w))] = f"Z{rnd.randint(0, 5)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(100, rows[7][1]), (700, "é " * 20000)]
    want = brute.near(rows)
    if small_cells:
        monkeypatch.setattr(minhash, "CELL_ROWS", 3)
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id], r.doc_id


def test_estimates_follow_similarity():
    import numpy as np

    from gristmill.llm.textblocks import mix

    pool = mix(np.arange(1, 4001, dtype=np.uint64))
    for shared in (100, 500, 900):
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - shared : 2000 - shared])
        bits = [minhash.signatures(x, np.array([len(x)]))[3] for x in (a, b)]
        assert abs(minhash.estimate(minhash.differing(bits[0], bits[1])[0]) - shared / (2000 - shared)) < 0.2


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, suffix_dedup.digest, minhash.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_index_counts_occurrences():
    import numpy as np

    rnd = np.random.default_rng(1)
    pieces = [rnd.integers(0, 4, n).astype(np.uint64) for n in (50, 1, 30, 80)]
    index = FMIndex(pieces)
    ends = np.concatenate([f + np.arange(1, len(p) + 1) for f, p in zip(index.first, pieces)])
    reach, lo, hi = index.matching(ends, 5)
    lists = [p.tolist() for p in pieces]
    count = lambda w: sum(p[i : i + len(w)] == w for p in lists for i in range(len(p) - len(w) + 1))
    k = 0
    for p in lists:
        for e in range(1, len(p) + 1):
            best = max((n for n in range(1, min(5, e) + 1) if count(p[e - n : e]) > 1), default=0)
            assert reach[k] == best and (best < 5 or hi[k] - lo[k] == count(p[e - 5 : e]))
            k += 1


def test_family_of_suffix_arrays_matches_counts():
    from collections import Counter

    rnd = random.Random(2)
    pieces = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(20, 60))) for _ in range(60)]
    family = SuffixFamily(20)
    for a in range(0, 60, 7):
        family.add(pieces[a : a + 7])
    windows = [p[i : i + 20] for p in pieces for i in range(len(p) - 19)]
    counts = Counter(windows)
    assert family.repeated().tolist() == [counts[w] > 1 for w in windows] and len(family.levels) <= 6

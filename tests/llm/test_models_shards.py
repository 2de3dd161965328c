import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import nn_descent, sharding, toxicity, url_filter
from gristmill.operators.compare import same_rows


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("on", "er", "th", "in") for b in ("tion", "an", "ou", "es", "ha") for c in ("", "ly", "ed", "re", "ing", "st", "nd", "wh")]
    bad = ["idiotic", "vilework", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 80))]
        y = int(rnd.random() < 0.2)
        for _ in range(y * rnd.randint(1, 5)):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad).upper() if rnd.random() < 0.3 else rnd.choice(bad) + ",")
        docs.append((seed * 10**6 + i, " ".join(words)))
        labels.append((seed * 10**6 + i, y))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(1500, 1)
    more, truth = toxic_rows(600, 2)
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert len(model.thresholds) == 1
    more += [(1, None), (2, ""), (3, "ontion " * 50000 + "vilework"), (3, "ontion")]
    frame = spark.createDataFrame(more, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    found = toxicity.score(frame, model).collect()
    assert len(found) == len(more)
    said = {r.doc_id: r for r in found}
    right = sum(said[k].toxic == bool(y) for k, y in truth)
    assert right >= 0.97 * len(truth) and not said[1].toxic and not said[2].toxic and all(0 <= r.severity <= 1 for r in found)
    kept = toxicity.clean(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r.toxic for r in found)


def test_likelihood_and_its_slope():
    """The fit against the plain likelihood: no small step from it does better."""
    rnd = np.random.default_rng(3)
    row, col = np.divmod(np.flatnonzero(rnd.random((200, 12)) < 0.3), 12)
    truth = rnd.standard_normal(12) * 2
    score = np.bincount(row, truth[col], 200) + rnd.logistic(size=200)
    grade = np.digitize(score, [-1.0, 0.5, 2.0])
    w, t = toxicity.fit_rows(row, col, 12, grade, l1=0.0, steps=2000)

    def likelihood(w, t):
        s = np.bincount(row, w[col], 200)
        over = np.hstack([np.ones((200, 1)), 1 / (1 + np.exp(t[None, :] - s[:, None])), np.zeros((200, 1))])
        return np.log(over[np.arange(200), grade] - over[np.arange(200), grade + 1]).sum()

    best = likelihood(w, t)
    assert np.all(np.diff(t) > 0) and np.corrcoef(w, truth)[0, 1] > 0.9
    for _ in range(200):
        assert likelihood(w + rnd.normal(0, 0.03, 12), t + rnd.normal(0, 0.03, 3)) <= best + 1e-3


def test_graded_labels_share_weights(spark):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(1500):
        y = rnd.choice([0, 0, 1, 2])
        words = [rnd.choice(plain) for _ in range(30)] + rnd.sample(["mean", "nasty", "cruel", "vile"], 2 * y)
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    known = spark.createDataFrame(labels[:1000], "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(frame, known)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    said = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert sum(said[k].grade == y for k, y in labels[1000:]) >= 480 and all(0 <= r.severity <= 2 for r in said.values())


def test_score_of_a_plain_model(spark):
    """Scores against a plain sum over a text's distinct words."""
    import re

    rnd = random.Random(6)
    vocabulary = ["Bad", "bad", "é", "x9", "ok", "fine"]
    rows = [(i, rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9)))) for i in range(80)] + [(None, "bad"), (None, None)]
    weights = {"bad": 1.5, "é": -2.0, "x9": 0.7}
    block = toxicity.Block(np.frombuffer("bad é x9".encode(), np.uint8), np.array([0, 9]))
    keys = toxicity.word_features(block)[1]
    order = np.argsort(keys)
    model = toxicity.OrdinalModel(keys[order], np.array([*weights.values()])[order], np.array([0.2, 1.1]))
    found = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit(9)), model).collect()
    want = []
    for k, x in rows:
        f = sum(weights.get(w, 0) for w in {w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", x or "")})
        want.append((k, round(sum(1 / (1 + np.exp(t - f)) for t in model.thresholds), 9)))
    assert sorted(((r.doc_id, round(r.severity, 9)) for r in found), key=repr) == sorted(want, key=repr)
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_toxicity_from_few_labels(spark):
    docs, labels = toxic_rows(60, 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    said = {r.doc_id: r.toxic for r in toxicity.score(frame, toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    assert sum(y for _, y in labels) < 20 and all(said[k] == bool(y) for k, y in labels)


def test_toxicity_of_a_small_given_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", F.col("toxic").alias("said")).join(labels, "doc_id").collect()
    assert sum(r.said for r in found if r.toxic) >= 10 and not any(r.said for r in found if not r.toxic)


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert [r.severity for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert not any(r.toxic for r in toxicity.score(docs, one).collect())


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/de/", "a.example.net", "/de/", "net/", "block"),
        ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
        ("https://w.org/fr/", "w.org", "/fr/", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, None),
        ("http://notexample.net?/en/", "notexample.net", "", None, None),
        ("http://internet/", "internet", "/", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("ftp://u#/a", "u", "", None, None),
        ("http://h/Ä/b", "h", "/Ä/b", None, None),
    ],
)
def test_urls(spark, url_model, url, host, path, rule, verdict):
    r = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), url_model).head()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.train(url_filter.training_urls(spark))


def test_url_model_generalises(spark, url_model):
    unseen = [("http://best-casino-online.biz/", 1), ("https://x.com/poker/room", 1), ("http://cheap-viagra.co/pills", 1), ("https://city-museum.edu/", 0), ("https://m.site.com/science/7", 0), ("http://library.uk/journal/1", 0)]
    out = {r.url_id: r.p_block for r in url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(unseen)], "page_id long, url string"), url_model).withColumnRenamed("page_id", "url_id").collect()}
    assert all((out[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(unseen))
    assert url_filter.train(spark.createDataFrame([], "url string, blocked int")).bias == 0


def test_nearest_neighbours(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((700, 16)) * rnd.uniform(0.5, 2, (700, 1))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] + [1.0] * 15), (1080, [None] + [1.0] * 15), (1100, [float("inf")] * 16)]
    found = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))).collect()
    hits = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        for r in own:
            assert abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 and r.vec_id != q
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(700), -np.round(score, 9)))[:20].tolist()))
    assert hits >= 0.9 * 35 * 20 and {r.query_id for r in found} == set(range(0, 700, 20))


def _uneven(kind):
    rnd = np.random.default_rng(5)
    if kind == "clusters":  # two so small that a query's neighbours lie in both, and others
        x = [rnd.standard_normal(16) * 3 + rnd.standard_normal((n, 16)) * 0.05 for n in [13, 13] + [20] * 12 + [40] * 6]
    elif kind == "norms":
        x = [rnd.standard_normal((600, 16)) * np.exp(1.5 * rnd.standard_normal((600, 1)))]
    else:
        x = [np.ones((300, 16)), rnd.standard_normal((200, 16))]
    x = np.vstack(x)
    return x[rnd.permutation(len(x))]


@pytest.mark.parametrize("kind,rounds", [("clusters", 8), ("norms", 8), ("copies", 8), ("norms", 0)])
def test_neighbours_of_uneven_vectors(spark, kind, rounds):
    """Every query has 20 rows, and recall holds; without any round of search by the scan."""
    x = _uneven(kind)
    rows = nn_descent.valid_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).cache()
    found = nn_descent.search(rows, nn_descent.build_graph(rows), rows.where("id % 20 = 0"), rounds=rounds).collect()
    hits, queries = 0, range(0, len(x), 20)
    for q in queries:
        own = [r for r in found if r.query_id == q]
        score = x @ x[q]
        score[q] = -np.inf
        assert sorted(r["rank"] for r in own) == list(range(1, 21)) and len({r.vec_id for r in own}) == 20
        hits += sum(r.score >= np.sort(score)[-20] - 1e-9 for r in own)
    assert hits >= (0.9 if rounds else 1.0) * 20 * len(queries)


def test_few_or_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])]
    found = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert nn_descent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_shards_are_compacted_by_size(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 20) as text", "cast(null as string) as lang")
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", base_bytes=20_000, fanout=3, target_bytes=2_000_000)
    for k in range(4):
        store.append(docs.where(f"doc_id % 4 = {k}").repartition(4))
    before = store.manifest()
    assert before.version == 4 and len(before.shards) == 16
    after = store.compact()
    assert len(after.shards) < len(before.shards) and after.version > 4
    tiers = [store.tier(s.size) for s in after.shards if s.size < store.target_bytes]
    assert all(tiers.count(t) < 3 for t in tiers) and sum(s.rows for s in after.shards) == 4000
    assert same_rows(store.read(), docs) and same_rows(store.read(2), docs.where("doc_id % 4 < 2"))
    assert store.vacuum() > 0 and same_rows(store.read(), docs) and store.versions() == [after.version]
    with pytest.raises(sharding.ConflictError):
        store._commit(after.version, after.schema, [])
    with pytest.raises(ValueError):
        store.append(docs.drop("lang"))


def test_empty_store(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    store = sharding.ingest(empty, f"file://{tmp_path}/e")
    assert store.read().count() == 0 and store.read().schema == empty.schema

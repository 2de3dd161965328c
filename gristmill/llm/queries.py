"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, minhash, nn_descent, sharding, substring_dedup, suffix_dedup, token_output, toxicity, url_filter
from .common import read_table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), url_filter.train(url_filter.training_urls(spark)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, read_table(spark, sf_dir, "labels")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read from the compacted store's last manifest."""
    store = sharding.ingest(read_table(spark, sf_dir, "documents"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_dataset(spark, token_output.write_dataset(read_table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_minhash": op3_minhash,
        "op4_nn_descent": op4_nn_descent,
        "op5_bpe": op5_bpe,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_sharding": op7_sharding,
        "op8_toxicity": op8_toxicity,
        "op9_decontaminate": op9_decontaminate,
        "op10_token_files": op10_token_files,
    }


#: Every window of 20 words by the order of its places; removed are words of windows that aren't the first of their content.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM w, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20
), placed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, k FROM placed, unnest(range(i, i + 20)) AS u(k) WHERE nth > 1
), words AS (
  SELECT doc_id, k, w[k] AS word FROM w, unnest(range(1, len(w) + 1)) AS u(k)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS line FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

#: All pairs that share a shingle, and what can be reached over links.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a
), components AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN components c ON d.doc_id = c.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

#: Bytes as two hexadecimal digits each; windows by the number of their 128-bit hash.
OP6_SQL = r"""
WITH h AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), sized AS (
  SELECT doc_id, h, CAST(len(h) // 2 AS BIGINT) AS n FROM h
), windows AS (
  SELECT doc_id, i, md5_number(h[2 * i + 1 : 2 * i + 400]) AS m FROM sized, unnest(range(0, n - 199)) AS u(i) WHERE n >= 200
), counted AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM windows
), marks AS (
  SELECT doc_id, pos, sum(d) AS d FROM (SELECT doc_id, i AS pos, 1 AS d FROM counted WHERE c > 1 UNION ALL SELECT doc_id, i + 200, -1 FROM counted WHERE c > 1) GROUP BY ALL
), depth AS (
  SELECT doc_id, pos, sum(d) OVER w AS deep, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM marks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), cut AS (
  SELECT doc_id, pos, next, deep, lag(deep, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM depth
), removed AS (
  SELECT doc_id, sum(next - pos) FILTER (WHERE deep > 0) AS n_removed, count(*) FILTER (WHERE deep > 0 AND before = 0) AS n_spans FROM cut GROUP BY doc_id
), keeps AS (  -- stretches between the removed ones
  SELECT doc_id, pos AS a, next AS z FROM cut WHERE deep = 0 AND next IS NOT NULL
  UNION ALL SELECT s.doc_id, 0, coalesce(min(pos), any_value(n)) FROM sized s LEFT JOIN cut c ON s.doc_id = c.doc_id GROUP BY s.doc_id
  UNION ALL SELECT s.doc_id, max(pos), any_value(n) FROM sized s JOIN cut c ON s.doc_id = c.doc_id GROUP BY s.doc_id
), lines AS (
  SELECT k.doc_id, string_agg(s.h[2 * a + 1 : 2 * z], '' ORDER BY a) AS line FROM keeps k JOIN sized s ON k.doc_id = s.doc_id WHERE z > a GROUP BY k.doc_id
)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(line, ''))) AS kept_sha256
FROM sized s LEFT JOIN removed r ON s.doc_id = r.doc_id LEFT JOIN lines l ON s.doc_id = l.doc_id
"""

#: The store must give back what came in, whatever shards it was in on the way.
OP7_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

#: Words and their sets by SQL's own functions; the automaton's query has no part in it.
OP9_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), lists AS (
  SELECT kind, id, doc_id, regexp_extract_all(t, '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM lowered
), items AS (
  SELECT DISTINCT id AS item, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS pattern, least(10, len(w)) AS n
  FROM lists, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE kind = 'b' AND len(w) > 0
), sizes AS (
  SELECT DISTINCT n FROM items
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS pattern
  FROM lists, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE kind = 'd' AND len(w) >= n
), hits AS (
  SELECT p.doc_id, p.i, p.n, t.item FROM places p JOIN items t ON p.pattern = t.pattern AND p.n = t.n
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lists l LEFT JOIN covered c ON l.doc_id = c.doc_id LEFT JOIN named m ON l.doc_id = m.doc_id WHERE l.kind = 'd'
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_minhash": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op7_sharding": OP7_SQL, "op9_decontaminate": OP9_SQL}

"""URL filter: explicit rules first, then logistic regression on hashed character n-grams.

A URL splits into host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased) and path (from there up to ``?``, ``#`` or the end). A rule (host, path, verdict) fits its
host and all subdomains when the URL's path starts with the rule's; the longest fitting rule wins,
the longer host before the longer path. Where no rule fits, a logistic model over character n-grams
of host and path, hashed into ``2**bits`` buckets with separate seeds for the two parts, decides.

The model is trained on a small labelled URL table (``training_urls`` unless another is given,
columns url and blocked; at most ``max_rows`` rows, the smallest hashes). Rules are few and are
compiled into one expression-free lookup by host suffix, so their number doesn't slow a URL down.

Cases: a null URL or one without ``://`` has empty host and path and no rule; the model judges it
by its bias alone; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of
from .textblocks import Block, block_of, byte_values, prefix_hash, row_slices_of, span_hash

MAX_ROWS = 20_000
BITS = 16
GRAMS = (3, 4, 5)

#: (host, path, verdict) of the query contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Words of the labelled table's hosts and paths, and their verdict.
BLOCKED_WORDS = "casino poker jackpot betting slots viagra pills replica torrent warez crack keygen adult escort webcam payday lottery clickbait spam malware".split()
ALLOWED_WORDS = "library museum school journal archive weather garden cooking history science health travel music sports news wiki forum market science docs".split()


def training_urls(spark: SparkSession) -> DataFrame:
    """A small labelled table: each word as host, as subdomain and as path over neutral surroundings."""
    rows = []
    for blocked, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, w in enumerate(words):
            for tld in ("com", "org", "info"):
                rows += [(f"http://www.{w}-{i}.{tld}/", blocked), (f"https://{w}.site{i}.{tld}/index.html", blocked), (f"https://m.page{i}.{tld}/{w}/{i}.html", blocked)]
    neutral = [(f"https://{a}.example.{tld}/{lang}/{n}", 0) for a in ("www", "blog", "m") for tld in ("com", "org") for lang in ("en", "de", "fr", "es") for n in (1, 20, 300, 4000)]
    return spark.createDataFrame(rows + neutral, "url string, blocked int")


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float
    bits: int

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score + self.bias, -500, 500)))


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    stop = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


class RuleBook:
    """Rules by host; a URL's host suffixes are looked up from the longest to the shortest."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.translate(_LOWER), []).append((path, f"{host}{path}", verdict))
        for own in self.by_host.values():
            own.sort(key=lambda r: (-len(r[0]), r[2]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while host:
            for prefix, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or len(name) > len(best[0])):
                    best = name, verdict
            at = host.find(".", at) + 1
            if at == 0:
                break
        return best


def gram_buckets(parts: list[bytes], bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all character n-grams of the parts, each wrapped in ``^`` and ``$``."""
    wrapped = [b"^" + p + b"$" for p in parts]
    data = np.frombuffer(b"".join(wrapped), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in wrapped])])
    owner = np.repeat(np.arange(len(parts)), np.diff(offsets))
    prefix = prefix_hash(byte_values(data))
    rows, buckets = [], []
    for n in GRAMS:
        s = np.arange(max(0, len(data) - n + 1))
        s = s[owner[s] == owner[s + n - 1]] if len(s) else s
        rows.append(owner[s])
        buckets.append(((span_hash(prefix, s, s + n) * np.uint64(2 * seed + 1)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def features(split: list[tuple[str, str]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    host = gram_buckets([h.encode() for h, _ in split], bits, 1)
    path = gram_buckets([p.encode() for _, p in split], bits, 0x5851F42D4C957F2D)
    return np.concatenate([host[0], path[0]]), np.concatenate([host[1], path[1]])


def train(labelled: DataFrame, bits: int = BITS, max_rows: int = MAX_ROWS, steps: int = 200, l2: float = 1e-4) -> UrlModel:
    """Fit on at most ``max_rows`` rows (url, blocked), by gradient descent with momentum on
    length-normalised n-gram counts."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).orderBy(F.xxhash64("url"), "url", "blocked").limit(max_rows).select("url", F.col("blocked").cast("int").alias("y")).collect()
    size = 1 << bits
    if not rows:
        return UrlModel(np.zeros(size), 0.0, bits)
    y = np.array([r.y > 0 for r in rows], float)
    row, col = features([split_url(r.url) for r in rows], bits)
    n = len(y)
    value = 1 / np.sqrt(np.bincount(row, minlength=n))[row]
    w, b = np.zeros(size), 0.0
    vw, vb = np.zeros(size), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col] * value, n) + b, -500, 500)))
        vw = 0.9 * vw - 0.5 * (np.bincount(col, (p - y)[row] * value, size) / n + l2 * w)
        vb = 0.9 * vb - 0.5 * float((p - y).mean())
        w, b = w + vw, b + vb
    return UrlModel(w, b, bits)


SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("p_block", pa.float64())])


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None, cut: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast((model, RULES if rules is None else rules))  # 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, given = shared.value
        book = RuleBook(given)
        for b in batches:
            urls = b.column("url").to_pylist()
            for a in range(0, len(urls), 4096):
                split = [split_url(u) for u in urls[a : a + 4096]]
                row, col = features(split, fitted.bits)
                scale = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(split))))
                p = fitted.probability(np.bincount(row, fitted.weights[col], len(split)) / scale)
                found = [book.find(h, q) for h, q in split]
                yield batch_of(
                    SCHEMA, b.column("page_id").slice(a, len(split)), [h for h, _ in split], [q for _, q in split], [f and f[0] for f in found],
                    [f[1] if f else "block" if x >= cut else "allow" for f, x in zip(found, p.tolist(), strict=True)], p,
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")

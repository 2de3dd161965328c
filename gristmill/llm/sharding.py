"""Size-tiered compaction of a table of immutable shards, in DataFrame operations only.

A store is a folder of Parquet files (shards) and versioned manifests. ``append`` writes arrivals as
small shards, one per task, without a shuffle. ``compact`` sorts shards into tiers by size (tier t
holds sizes in [base * fanout**t, base * fanout**(t + 1))) and rewrites every tier of at least
``fanout`` shards into files of about ``target_bytes``: Spark's own file packing puts whole shards of
similar size together until a task has that much, so a merge moves no row between tasks. Shards of
the target size or more are left alone. Each change is committed as manifest N+1 by an atomic
rename that fails if N+1 exists, so of two writers one must retry on the newer version; readers see
one version or the other, and data without a manifest is invisible. ``vacuum`` deletes what only older
versions name.

The driver handles file names and sizes (metadata); rows stay in the executors.

Cases: nulls, empty and very long texts, repeated rows and extra columns are stored as they are;
an empty arrival adds no shard; an empty store reads as an empty table of its schema; an arrival
whose columns differ from the store's is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import work_path


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    size: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class ConflictError(RuntimeError):
    """Another writer committed first."""


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, base_bytes: int = 1 << 20, fanout: int = 4, target_bytes: int = 128 << 20):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.base_bytes, self.fanout, self.target_bytes = base_bytes, fanout, target_bytes
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, relative: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{relative}" if relative else self.folder)

    # manifests

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        known = self.versions()
        if not known:
            return None
        stream = self._fs.open(self._path(f"manifests/v{known[-1] if version is None else version:012d}.json"))
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(told["version"], told["schema"], tuple(Shard(**s) for s in told["shards"]))

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> Manifest:
        new = Manifest(version, schema, tuple(shards))
        held = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode("utf-8")))
        finally:
            out.close()
        final = self._path(f"manifests/v{version:012d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(held.toUri() if held.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(held, final, none)
        except Exception as e:
            self._fs.delete(held, False)
            if self._fs.exists(final):
                raise ConflictError(f"version {version} was committed by another writer") from e
            raise
        return new

    # writes

    def _write(self, df: DataFrame) -> list[Shard]:
        """Write ``df`` as it is partitioned; the shards that have rows."""
        run = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{run}")
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(run)) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        # a row a file, from the footers
        counts = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{run}").groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect()
        return [Shard(f"{run}/{r.name}", sizes[r.name], r.n) for r in sorted(counts)]

    def append(self, df: DataFrame) -> Manifest:
        held = self.manifest()
        schema = df.schema.json()
        if held and [(f.name, f.dataType) for f in StructType.fromJson(json.loads(held.schema))] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("the arrival's columns differ from the store's")
        new = self._write(df)
        return self._commit(held.version + 1 if held else 1, held.schema if held else schema, [*(held.shards if held else ()), *new])

    def tier(self, size: int) -> int:
        t = 0
        while size >= self.base_bytes * self.fanout ** (t + 1):
            t += 1
        return t

    def compact(self) -> Manifest | None:
        """Merge tiers until none has ``fanout`` shards below the target size."""
        while held := self.manifest():
            tiers: dict[int, list[Shard]] = {}
            for s in held.shards:
                if s.size < self.target_bytes:
                    tiers.setdefault(self.tier(s.size), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if full is None:
                return held
            new = self._merge(full, held.schema)
            if len(new) >= len(full):  # nothing to gain from files of this size
                return held
            gone = set(full)
            self._commit(held.version + 1, held.schema, [*(s for s in held.shards if s not in gone), *new])
        return None

    def _merge(self, shards: list[Shard], schema: str) -> list[Shard]:
        conf = self.spark.conf
        names = {"spark.sql.files.maxPartitionBytes": str(self.target_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: conf.get(k, None) for k in names}
        for k, v in names.items():
            conf.set(k, v)
        try:
            rows = self._frame(shards, schema)
            files = max(1, round(sum(s.size for s in shards) / self.target_bytes))
            return self._write(rows.coalesce(files))
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last ``keep`` versions names, and older manifests; how many
        files went."""
        known = self.versions()
        live = {s.path for v in known[-keep:] for s in self.manifest(v).shards}
        dead = {s.path for v in known[:-keep] for s in self.manifest(v).shards} - live
        for p in dead:
            self._fs.delete(self._path(p), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:012d}.json"), False)
        return len(dead)

    # reads

    def _frame(self, shards, schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*(f"{self.folder}/{s.path}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        if held is None:
            raise ValueError("the store has no version yet")
        return self._frame(held.shards, held.schema)


def ingest(documents: DataFrame, folder: str | None = None, arrivals: tuple[int, ...] = (8, 4, 2, 1), **sizes) -> ShardStore:
    """Append ``documents`` in arrivals of these relative sizes (rows dealt by a hash of doc_id),
    compacting after each."""
    spark = documents.sparkSession
    store = ShardStore(spark, folder or work_path(spark, "shards"), **sizes)
    deal, at = F.pmod(F.xxhash64("doc_id"), F.lit(sum(arrivals))), 0
    for n in arrivals:
        store.append(documents.where((deal >= at) & (deal < at + n)))
        store.compact()
        store.vacuum()
        at += n
    return store

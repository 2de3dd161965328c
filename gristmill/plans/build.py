"""Building views: staged writes, one promoting rename, a registry of what is ready.

Views are built from one cached base frame, several at a time (Spark runs the jobs side by side).
A view is written to a staging folder of its own and moved into place only when complete; readers
go by the registry, which is written last. Metadata goes through Hadoop's file system interface,
so the folder may be on any store Spark can write.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import MVDef

READY, BUILDING, FAILED, STALE = "READY", "BUILDING", "FAILED", "STALE"


@dataclass(frozen=True)
class ViewState:
    status: str = STALE
    rows: int = 0
    schema: str = ""
    path: str = ""
    error: str = ""
    built_at: float = 0.0
    seconds: float = 0.0


class SchemaDrift(RuntimeError):
    pass


class ViewStore:
    """A folder of views and ``registry.json``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.states: dict[str, ViewState] = {}
        self._frames: dict[str, DataFrame] = {}
        self.load()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def load(self) -> None:
        at = self._path("registry.json")
        if self._fs.exists(at):
            stream = self._fs.open(at)
            try:
                told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            self.states = {k: ViewState(**v) for k, v in told.items()}

    def save(self) -> None:
        out = self._fs.create(self._path("registry.json"), True)
        try:
            out.write(bytearray(json.dumps({k: asdict(v) for k, v in self.states.items()}, indent=1).encode()))
        finally:
            out.close()

    def state(self, name: str) -> ViewState:
        return self.states.get(name, ViewState())

    def ready(self, name: str) -> bool:
        return self.state(name).status == READY

    def mark_stale(self, name: str) -> None:
        self.states[name] = ViewState(**(asdict(self.state(name)) | {"status": STALE}))
        self.save()

    def rows(self) -> dict[str, int]:
        return {k: s.rows for k, s in self.states.items() if s.status == READY}

    def read(self, name: str) -> DataFrame:
        """The view's frame; files are listed once for each build."""
        path = self.state(name).path
        if path not in self._frames:
            self._frames[path] = self.spark.read.parquet(path)
        return self._frames[path]

    def build(self, mv: MVDef, base: DataFrame) -> ViewState:
        """Write, count from the footers, promote; a failure leaves the old view in place."""
        began, before = time.time(), self.state(mv.name)
        staging, final = f"_staging/{uuid.uuid4().hex}", f"{mv.name}/{uuid.uuid4().hex[:12]}"
        try:
            frame = mv.frame(base)
            schema = frame.schema.json()
            if before.schema and before.schema != schema:
                raise SchemaDrift(f"{mv.name}: columns differ from the registered ones")
            # few files of a good size, each with a range of dimension values of its own: a filter on the
            # leading dimension skips row groups, and a small view is one small file
            if mv.partition:
                frame = frame.hint("rebalance", *mv.partition)
            frame.sortWithinPartitions(*mv.partition, *(d for d in mv.dims if d not in mv.partition)).write.option("compression", "zstd").parquet(f"{self.folder}/{staging}")
            rows = self.spark.read.parquet(f"{self.folder}/{staging}").count()
            self._fs.mkdirs(self._path(mv.name))
            if not self._fs.rename(self._path(staging), self._path(final)):
                raise OSError(f"{mv.name}: promotion failed")
            new = ViewState(READY, rows, schema, f"{self.folder}/{final}", "", time.time(), time.time() - began)
        except Exception as e:
            self._fs.delete(self._path(staging), True)
            new = ViewState(**(asdict(before) | {"status": READY if before.status == READY else FAILED, "error": str(e)[:500]}))
        self.states[mv.name] = new
        return new

    def build_all(self, views: list[MVDef], base: DataFrame, workers: int = 4, cache: bool = True) -> dict[str, ViewState]:
        base = base.persist() if cache else base
        try:
            with ThreadPoolExecutor(workers) as pool:
                done = dict(zip([v.name for v in views], pool.map(lambda v: self.build(v, base), views), strict=True))
        finally:
            if cache:
                base.unpersist()
        self.save()
        return done

    def clean_staging(self, max_age_s: float = 24 * 3600) -> int:
        """Delete staging folders that are older."""
        at, gone = self._path("_staging"), 0
        if self._fs.exists(at):
            for s in self._fs.listStatus(at):
                if time.time() - s.getModificationTime() / 1000 >= max_age_s:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def fits(base: DataFrame, grain: str, dim: str, most: int = 80_000_000) -> bool:
    """Whether a wide view stays under ``most`` rows: distinct values times time buckets, estimated
    in one pass."""
    low, high, distinct = base.agg(F.min("day"), F.max("day"), F.approx_count_distinct(dim)).head()
    if low is None:
        return True
    days = (high - low).days + 1
    buckets = {"day": days, "week": max(1, days // 7 + 1), "hour": 24 * days}[grain]
    return distinct * buckets <= most

"""Helpers shared by the corpus operators: shared work folders, tables and Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_HELD: dict[tuple, object] = {}
#: Of glibc; other C libraries have none.
_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hold(key: tuple, make: Callable[[], object]):
    """A worker's one large object: kept for the next tasks of the same operator, dropped when a
    task asks for another or calls ``release``. Python workers live on from stage to stage."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop the held object, and give back what it and earlier tasks have left."""
    _HELD.clear()
    trim()


def trim() -> None:
    """Give free memory back to the system. Arrow's pool and the C heap keep what is freed between
    blocks that are in use, in a worker that lives on through all stages."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM:
        _MALLOC_TRIM(0)


def make_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. A cluster whose machines
    don't have that folder needs the package shipped (``--py-files``), as any PySpark library does."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
    # texts vary in length, so batches are better bounded by bytes
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "67108864"):
        spark.conf.set(key, "12m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a folder of our own where the
    session names none (single-machine sessions such as tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/gristmill-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and a lost executor
    costs at most the stage that reads the files."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def quoted(df: DataFrame) -> list[Column]:
    """Its columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keep_rows(df: DataFrame, keep: Callable[[Iterator[pa.Array]], Iterator[tuple[pa.Array, int, int]]]) -> DataFrame:
    """The rows of ``df``, all columns kept, that ``keep`` marks. It is given the text column of each
    batch and yields (mask, from, to) of slices of it. Columns may have any names."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    text = f"c{df.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list[pa.RecordBatch] = []

        def texts() -> Iterator[pa.Array]:
            for b in batches:
                current[:] = [b]
                yield b.column(text)

        for mask, a, z in keep(texts()):
            yield current[0].slice(a, z - a).filter(mask)

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def row_slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` at most; a larger row stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )

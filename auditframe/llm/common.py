"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
    (single-machine tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="auditframe-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/auditframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below a shared path and read it again: cuts the lineage, survives lost executors."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, name: str = "part") -> DataFrame:
    return stored(df, f"{shared_dir(df.sparkSession)}/{name}")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have (Spark compares them without case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Free memory of this Python worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` of a Python worker that gives its free memory back when a task ends: workers live on, beside the JVM's next stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def map_rows(docs: DataFrame, run, added: dict[str, DataType] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``docs.mapInArrow(run)`` for column names of any kind; rows keep the columns of ``docs`` but for ``more``, and get those of ``added``.

    ``run`` sees and makes columns by place.
    """
    names = [*(c for c in docs.columns if c not in more), *(added or {})]
    kept = [f for f in docs.schema.fields if f.name not in more]
    kinds = [*(f.dataType for f in kept), *(added or {}).values()]
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(run), StructType([StructField(f"c{i}", k) for i, k in enumerate(kinds)])).toDF(*names)


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a written table), to be broadcast if it has no more than ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``chars`` characters each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

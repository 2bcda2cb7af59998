"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or in plain local mode a folder of this run."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="plyweave-")
    return "file://" + _OWN[app]


def fresh(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{scratch(spark)}/plyweave/{uuid.uuid4().hex}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read again: later stages neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.plyweave_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Deletes written tables (or folders) that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        if path := t if isinstance(t, str) else getattr(t, "plyweave_path", None):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(docs: DataFrame, most: int = 4 << 20) -> DataFrame:
    """docs, once the session passes whole texts to Python workers in batches of at most so many bytes. The setting stays, as
    plans are run after the call; one that the session has already is kept."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(most))
    return docs


def trim() -> None:
    """Gives this process's freed memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Lets driver and executors give back the memory that earlier work has filled: a full collection shrinks their heaps,
    which otherwise only grow. One task for each core, half a second each; for use between long stages."""
    trim()
    spark._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collect.alias("done")).write.format("noop").mode("overwrite").save()


def portions(batches, column: int = 0, most: int = 4 << 20):
    """The batches in slices of at most so many bytes of text (one row at least), so that no slice's work is large."""
    for b in batches:
        text = b.column(column)
        sizes = np.nan_to_num(pc.binary_length(text).to_numpy(zero_copy_only=False).astype("f8"))
        ends = np.cumsum(sizes)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession) -> int:
    """Partitions for work that has no natural number of them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z in lower case, every other character untouched."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df (cheap to read: written before, or a configuration table) has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def without(docs: DataFrame, dropped: DataFrame, rows: int = 400_000) -> DataFrame:
    """docs less the rows whose doc_id and text hash are in dropped (doc_id, th), which is broadcast if its counted rows are few.

    Null ids are equal to each other, and null texts to empty ones; rows that are repeated in docs go or stay together.
    """
    told = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    gone = written(dropped.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "dropped")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (told == gone["gone_th"])
    return docs.join(F.broadcast(gone) if small_enough(gone, rows) else gone, same, "left_anti")

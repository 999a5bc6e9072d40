"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of some numbers each that are broadcast at most: 12 MB.
BROADCAST_ROWS = 500_000
#: Paths of the tables stored on the way to a settled one.
_ON_THE_WAY: ContextVar[list[str] | None] = ContextVar("on_the_way", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given data directory, by a path that any Spark reader opens."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session without one, whose executors are the driver itself, gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    on_the_way = _ON_THE_WAY.get()
    if on_the_way is not None:
        on_the_way.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table, to be broadcast if it is counted to have few rows; many meet others by a shuffle."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str = "table") -> DataFrame:
    """What make() returns, stored; the tables that it stored on the way are deleted, as nothing depends on them any more."""
    token = _ON_THE_WAY.set([])
    try:
        made = make()
        path = fresh_path(spark, what)
        made.write.parquet(path)
        schema = made.schema
    finally:
        paths = _ON_THE_WAY.get()
        _ON_THE_WAY.reset(token)
        for old in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    # Spark removes a shuffle's files once the driver has collected the plan that made them.
    del made
    gc.collect()
    spark._jvm.System.gc()
    outer = _ON_THE_WAY.get()
    if outer is not None:
        outer.append(path)
    return spark.read.schema(schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """Only the id and the whole text (null: empty), whatever other columns the input has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def bucket(*cols, n: int, seed: int = 0):
    """An even bucket number 0..n-1 from the hash of some columns; nulls go like any value."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n)).cast("int")

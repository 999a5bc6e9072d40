"""Cutting lineage: iterative steps write their tables to the shared folder, go on from there, and delete what they no longer need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables stored since the innermost `passing` began; None outside of any.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a table under spark.checkpoint.dir, a folder that driver and executors share, and read it back; survives lost executors.

    A local session without such a folder, whose executors are the driver itself, gets a temporary one.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    paths = _PASSING.get()
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside are deleted at the end, but those stored by the function that it gives.

    What is kept belongs to the `passing` around this one, if there is any. Only kept tables may be used afterwards.
    """
    outer, own = _PASSING.get(), []
    token = _PASSING.set(own)

    def kept(df: DataFrame, what: str = "table") -> DataFrame:
        out = stored(df, what)
        path = own.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield kept
    finally:
        _PASSING.reset(token)
        for path in own:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

"""Written intermediates that are deleted when their last reader is done."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

from feedloom.operators.stages import shared_folder


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
SHUFFLE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Arrow batches hold about ``BATCH_BYTES`` (one row at least), whatever the session says, so rows that carry long texts or sets do
    not fill a task's memory by their number. Holds for what runs inside the block, not for what is read later."""
    return _setting(spark, BATCH_KEY, str(BATCH_BYTES))


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs inside the block deletes its shuffle files when it ends, not when the driver's memory is next cleaned."""
    return _setting(spark, SHUFFLE_KEY, "true")


class Scratch:
    """``with Scratch(spark) as scratch: part = scratch(df)`` writes ``df`` to the shared folder and reads it from there. ``drop`` deletes
    one table, the end of the block the others: results that outlive it have to be written by their own means.

    Inside the block Arrow batches are small and shuffle files go with the job that wrote them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.settings = ExitStack()

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark).rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Scratch:
        self.settings.enter_context(small_batches(self.spark))
        self.settings.enter_context(brief_shuffles(self.spark))
        return self

    def __exit__(self, *_) -> None:
        self.settings.close()
        self.drop(*[table for table, _ in self.paths.values()])

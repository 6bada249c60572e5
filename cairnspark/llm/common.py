"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of anything but these six characters.
WORD_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The array of words of a text; empty for null and for text without a word."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir. Only where driver and executors are
    one process may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        base = f"file://{tempfile.gettempdir()}/cairnspark-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` stored as Parquet and read back: cuts the lineage with files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its URI names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Memo(dict):
    """Values by string, made on demand. Bounded in bytes: full, it is emptied; values of long strings are made each time."""

    #: Bytes that it holds about, besides keys and values for each entry; length of the longest key.
    LIMIT, ENTRY, LONGEST = 160 << 20, 200, 64

    def __init__(self, make: Callable):
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.LONGEST:
            self.held += self.ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.held > self.LIMIT:
                self.clear()
                self.held = 0
            self[key] = value
        return value


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside; other queries of the session see it too, so it must not change results."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside, so that long texts stay small in memory."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def one_thread() -> None:
    """Library thread pools off, in a Python worker: Spark already runs one task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"

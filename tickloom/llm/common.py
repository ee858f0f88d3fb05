"""What several operators share: tables, stored intermediate results, bound names and word splitting."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

#: White space of the token rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that go when the innermost ``passing`` ends.
_PASSING: ContextVar[list[str] | None] = ContextVar("_PASSING", default=None)


def stored(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write an intermediate result to the cluster's shared folder and read it from there: it is computed once, and a lost
    executor costs a re-read instead of a re-computation. zstd: these tables count as disk. Inside ``passing`` the table goes at
    its end, unless it ``stays``."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if (passing_tables := _PASSING.get()) is not None and not stays:
        passing_tables.append(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Removes the tables stored inside when it ends, so what is computed inside must be stored to stay. Shuffle files of the jobs
    inside go too, as soon as the driver's garbage collection has found that nothing refers to them."""
    paths: list[str] = []
    before = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(before)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is never inlined, a projected column may be."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null, empty and blank texts."""
    bare = F.trim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus

"""What the corpus operators share: staging in the shared folder, unused column names, batches for Python, files.

Every file that one task writes and another reads lies in the folder named by ``spark.checkpoint.dir`` (see
``tessera.sources.folders``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import delete, scratch

__all__ = ["delete", "file_system", "matched", "refuse", "release", "scratch", "small_batches", "staged", "staged_at", "table", "unused"]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write the rows to the shared folder and read them back: cuts the lineage, survives lost executors. Also where they are."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    return staged_at(df, name)[0]


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one with which no column of the table begins, for what an operator adds and takes away."""
    name = f"__{name}"
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def refuse(df: DataFrame, *names: str) -> None:
    """An error if the table has one of the columns that an operator would add: it overwrites none."""
    if clash := sorted({c.lower() for c in df.columns} & {n.lower() for n in names}):
        raise ValueError(f"the table has a column {clash[0]} already; give another name or prefix")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Tasks that run while this holds get whole texts in batches of fewer rows: their Python workers need less memory.

    Results are the same for any number.
    """
    old = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, old)


def matched(rows: DataFrame, ones: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with a table that has one row for each value of the key, and in ``n`` how many of the ``total`` rows have it.

    Values that more than a ten-thousandth of the rows have (there are 10,000 at most) are joined by broadcast, where the rows
    are; the others by key. So no task gets a value that is hot.
    """
    often = max(100, total // 10_000)
    hot = F.broadcast(ones.where(F.col("n") > often).drop("n"))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(ones.where(F.col("n") <= often).drop("n"), key))


def release() -> None:
    """Give memory that a Python task has freed back to the system: its worker stays for other tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str):
    """The file system of a URI and the path in it, for Python tasks that write or range-read archives."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)

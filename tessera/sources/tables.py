"""Stored tables: heaps and clustered tables in Parquet, and the pipe-delimited text form.

A table is a list of runs, one for each append, overwrite or streamed batch; a run is a folder of Parquet files. The list
is a log of versions (see ``versions``), so a reader sees whole runs, and replacing all runs by one is a single step. A heap
keeps append order by runs; the files of all runs in that order are its pages. A clustered table's runs are written in ranges of its key, sorted within, so that
closed ranges skip files and row groups by their statistics; ``recluster`` merges the runs into one.
Loading text replaces the table's rows and records row and distinct counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import BOOL, DOUBLE, INT, LONG, STRING, EngineError, Schema, kind_of, printed, struct, to_text
from tessera.operators.relational import statistics
from tessera.sources.catalog import CLUSTERED, Table
from tessera.sources.folders import qualified
from tessera.sources.versions import Log, State

NUMBER = {INT: r"^\s*([+-]?\d+)", LONG: r"^\s*([+-]?\d+)", DOUBLE: r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def parsed(value: Column, kind: str, name: str) -> Column:
    """A field's text as a value. Numbers may be followed by other text, which is dropped, as the text form allows."""
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{name}: not {what}: "), value))
    if kind == STRING:
        return value
    if kind == BOOL:
        return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False)).otherwise(wrong("a bool").cast("boolean"))
    own = F.regexp_extract(value, NUMBER[kind], 1)
    target = {INT: "int", LONG: "bigint", DOUBLE: "double"}[kind]
    return F.when(own != "", F.when(own != "", own).otherwise(F.lit("0")).cast(target)).otherwise(wrong(f"an {kind}").cast(target))


def from_lines(lines: DataFrame, schema: Schema) -> DataFrame:
    """The rows of a column ``value`` of text lines; empty lines are none, and a line with too few fields is an error."""
    few = F.raise_error(F.concat(F.lit(f"fewer than {len(schema)} fields: "), F.col("value"))).cast("array<string>")
    split = lines.where(F.length("value") > 0).select("value", F.split("value", "[|]", -1).alias("f"))
    split = split.select(F.when(F.size("f") >= len(schema), F.col("f")).otherwise(few).alias("f"))
    return split.select(*[parsed(F.element_at("f", i + 1), k, n).alias(n) for i, (n, k) in enumerate(schema)])


def read_text(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Rows of pipe-delimited text; the last delimiter of a line may be missing. A missing file has no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], struct(schema))
    return from_lines(spark.read.text(path), schema)


def as_lines(df: DataFrame) -> DataFrame:
    """One text column: every field followed by a pipe, doubles with six decimals."""
    own = printed(df)
    return own.select(F.concat(*[F.concat(to_text(F.col(f"`{f.name}`"), kind_of(f.dataType)), F.lit("|")) for f in own.schema.fields]).alias("value"))


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_lines(df).write.mode(mode).text(path)


def clustered(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The rows in ranges of the key, sorted within each."""
    by = F.col(f"`{key}`")
    out = df.repartitionByRange(partitions, by) if partitions else df.repartitionByRange(by)
    return out.sortWithinPartitions(by)


class Stored:
    """A stored table: its definition and its rows."""

    def __init__(self, spark: SparkSession, table: Table) -> None:
        self.spark, self.table = spark, table
        self.root = qualified(spark, table.path.rstrip("/"))
        self.log = Log(spark, f"{self.root}/_versions")

    def _rows(self, paths: list[str]) -> DataFrame:
        schema = self.table.spark_schema()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def runs(self) -> list[str]:
        """Folders of the table's runs, in the order in which they came."""
        return [f"{self.root}/{run}" for run in self.log.state().entries]

    def read(self) -> DataFrame:
        return self._rows(self.runs())

    def _run(self, df: DataFrame) -> str:
        """Write a run that no version lists yet; its name."""
        missing = [n for n, _ in self.table.schema if n not in df.columns]
        if missing:
            raise EngineError(f"{self.table.name}: no column {missing[0]} in the rows")
        own = printed(df).select(*[F.col(f"`{n}`").cast(self.table.spark_schema()[n].dataType) for n, _ in self.table.schema])
        if self.table.file_type == CLUSTERED:
            own = clustered(own, self.table.sort_att)
        name = f"run-{uuid.uuid4().hex}"
        own.write.parquet(f"{self.root}/{name}")
        return name

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Add the rows as one run. batch: a stream and its batch's number; one that was added before is not added again."""
        old = self.log.state()
        streams = old.meta.get("streams", {})
        if batch is None:
            self.log.commit(old, {self._run(df): []}, [])
        elif streams.get(batch[0], -1) < batch[1]:
            self.log.commit(old, {self._run(df): []}, [], {"streams": streams | {batch[0]: batch[1]}})

    def _swap(self, old: State, run: str) -> None:
        self.log.commit(old, {run: []}, list(old.entries))

    def overwrite(self, df: DataFrame) -> None:
        """Replace the rows in one step; df may read this table."""
        old = self.log.state()
        self._swap(old, self._run(df))

    def clear(self) -> None:
        old = self.log.state()
        self.log.commit(old, {}, list(old.entries))

    def recluster(self) -> None:
        """Merge the sorted runs of a clustered table into one. Readers see all runs or the new one; ``vacuum`` removes the old."""
        old = self.log.state()
        self._swap(old, self._run(self._rows([f"{self.root}/{run}" for run in old.entries])))

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Remove files of runs that none of the last ``keep`` versions has, but for recent ones; how many went."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files, found = [], self.log.fs.listFiles(path(self.root), True)
        while found.hasNext():
            x = found.next()
            name = qualified(self.spark, x.getPath().toString()).removeprefix(f"{self.root}/")
            if name.startswith("run-"):
                files.append((name, x.getModificationTime()))
        gone = self.log.unlisted(files, keep, hours)
        for name in gone:
            self.log.fs.delete(path(f"{self.root}/{name}"), False)
        self.log.forget(keep)
        return len(gone)

    # pages

    def files(self) -> list[str]:
        """The table's pages: its Parquet files by run, then by name. Their order holds until the runs are merged."""
        path, out = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
        for run in self.runs():
            names = [x.getPath().toString() for x in self.log.fs.listStatus(path(run))]
            out += sorted(n for n in names if n.endswith(".parquet"))
        return out

    def page(self, k: int) -> DataFrame:
        return self.page_range(k, k)

    def page_range(self, low: int, high: int) -> DataFrame:
        """Rows of the pages low to high, both included, counted from 0; other files aren't opened."""
        return self._rows(self.files()[max(0, low) : max(0, high + 1)])

    def layout(self) -> DataFrame:
        """(file, low, high, n_rows): what each file holds of the key, or of the first column of a heap."""
        key = F.col(f"`{self.table.sort_att or self.table.schema[0][0]}`")
        return self.read().groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_rows"))

    def load(self, path: str) -> Table:
        """Replace the rows by those of a text file and record their counts."""
        self.overwrite(read_text(self.spark, path, self.table.schema))
        found = statistics(self.read()).collect()
        self.table.tuple_count = found[0]["n_rows"]
        self.table.distinct = {r["column_name"]: r["n_distinct"] for r in found}
        return self.table

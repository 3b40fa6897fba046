"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as small immutable Parquet shards. Compaction puts shards of similar size into tiers, merges the
runs of a tier that holds enough of them into files of about the target size, and leaves full shards alone. Each change is
one new version of the manifest (``tessera.sources.versions``): it says which shards come and go, and is renamed into place
without overwriting, so that a reader sees a whole version or none of it, and of two writers one fails and can try again.
A manifest file holds the change alone, and now and then the whole list, so that many arrivals cost no more than their
shards. Shards that no version lists, such as those of a lost attempt, are never read. Nothing is removed but by
``vacuum``, which the caller runs: it spares what the last versions list, and recent files, which may be another writer's.

A merge reads its shards in one task and writes one file, so nothing is shuffled and a hot source is no matter; merges
run side by side. Defined cases: rows are stored as they are, nulls, empty and very long texts and repeated rows included;
an arrival without rows (or an empty table) adds no shard and no version; arrivals of equal number are one; all appends must
have the columns of the first (in any order), else they are refused, as is a table with a column ``__arrival``.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.folders import qualified
from tessera.sources.versions import Conflict, Log, State

__all__ = ["Conflict", "Shard", "Store", "compacted", "merges", "tiers"]

#: Bytes of a full shard; shards of a tier before they merge, and at most in one merge; sizes that count as similar.
TARGET, LEAST, MOST, SIMILAR = 64 << 20, 4, 64, (0.5, 1.5)
#: Shards under this many bytes are one tier, and merges that run side by side.
SMALL, BESIDE = 1 << 20, 8
ARRIVAL = "__arrival"


class Shard(NamedTuple):
    path: str
    bytes: int
    rows: int


def shards_of(state: State) -> list[Shard]:
    return [Shard(path, *values) for path, values in state.entries.items()]


def tiers(shards: list[Shard], target: int = TARGET, small: int = SMALL, similar: tuple[float, float] = SIMILAR) -> list[list[Shard]]:
    """Shards that are not full, by similar size, smallest first."""
    out: list[list[Shard]] = []
    mean = 0.0
    for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
        if s.bytes >= target * similar[0]:
            continue
        if out and (s.bytes < small or mean * similar[0] <= s.bytes <= mean * similar[1]):
            out[-1].append(s)
        else:
            out.append([s])
        mean = sum(x.bytes for x in out[-1]) / len(out[-1])
    return out


def merges(shards: list[Shard], target: int = TARGET, least: int = LEAST, most: int = MOST, small: int = SMALL) -> list[list[Shard]]:
    """Groups of shards to merge now: runs of a tier that together reach the target, or a whole rest of enough shards."""
    out = []
    for tier in tiers(shards, target, small):
        group: list[Shard] = []
        for s in tier:
            group.append(s)
            if len(group) > 1 and sum(x.bytes for x in group) >= target * 0.9 or len(group) >= most:
                out.append(group)
                group = []
        if len(group) >= least:
            out.append(group)
    return out


class Store:
    """A versioned set of shards in a folder."""

    def __init__(self, spark: SparkSession, uri: str, target: int = TARGET, least: int = LEAST, most: int = MOST, small: int = SMALL) -> None:
        self.spark, self.uri, self.target, self.least, self.most, self.small = spark, qualified(spark, uri.rstrip("/")), target, least, most, small
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.log = Log(spark, f"{self.uri}/manifests")
        self._fs = self.log.fs

    # manifests

    def versions(self) -> list[int]:
        return self.log.versions()

    def shards(self, version: int | None = None) -> list[Shard]:
        return shards_of(self.log.state(version))

    def commit(self, old: State, add: list[Shard], remove: list[Shard], schema: str) -> State:
        """The next version after ``old``; Conflict if another writer has made it."""
        return self.log.commit(old, {s.path: [s.bytes, s.rows] for s in add}, [s.path for s in remove], {"schema": schema})

    # data

    def _files(self, folder: str) -> list[tuple[str, int]]:
        out, found = [], self._fs.listFiles(self._path(folder), True)
        while found.hasNext():
            x = found.next()
            if x.getPath().getName().endswith(".parquet"):
                out.append((x.getPath().toString(), x.getLen()))
        return sorted(out)

    def _rows(self, folder: str) -> dict[str, int]:
        """Rows of each file of a folder, from the files' footers."""
        counts = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["p"].rpartition("/")[0].rpartition("/")[2] + "/" + r["f"]: r["n"] for r in counts}

    def _written(self, folder: str) -> list[Shard]:
        files = self._files(folder)
        rows = self._rows(folder) if files else {}
        return [s for p, n in files if (s := Shard(p, n, rows.get("/".join(p.rsplit("/", 2)[1:]), 0))).rows]

    def append(self, df: DataFrame, arrival: Column | None = None) -> list[int]:
        """Write the rows as shards; a version for each arrival (value of the column), in ascending order."""
        if ARRIVAL in df.columns:
            raise ValueError(f"{ARRIVAL} is the store's own column")
        old = self.log.state()
        if "schema" in old.meta:
            names = T.StructType.fromJson(json.loads(old.meta["schema"])).names
            if sorted(names) != sorted(df.columns):
                raise ValueError(f"columns must be {names}")
            df = df.select(*[f"`{n}`" for n in names])
        schema = old.meta.get("schema") or df.schema.json()
        folder = f"{self.uri}/data/{uuid.uuid4().hex}"
        if arrival is None:
            df.write.parquet(folder)
            groups = {"": self._written(folder)}
        else:
            df.withColumn(ARRIVAL, F.coalesce(arrival.cast("bigint"), F.lit(0))).write.partitionBy(ARRIVAL).parquet(folder)
            groups = {}
            for s in self._written(folder):
                groups.setdefault(int(s.path.rsplit("/", 2)[1].partition("=")[2]), []).append(s)
        out = []
        for key in sorted(groups):
            if groups[key]:
                old = self.commit(old, groups[key], [], schema)
                out.append(old.version)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        held = self.log.state(version)
        if "schema" not in held.meta:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(held.meta["schema"]))
        paths = list(held.entries)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self) -> int | None:
        """One round of merges; the new version, or None if no tier has enough shards."""
        old = self.log.state()
        groups = merges(shards_of(old), self.target, self.least, self.most, self.small)
        if not groups:
            return None
        schema = T.StructType.fromJson(json.loads(old.meta["schema"]))

        def merge(group: list[Shard]) -> list[Shard]:
            folder = f"{self.uri}/data/{uuid.uuid4().hex}"
            self.spark.read.schema(schema).parquet(*[s.path for s in group]).coalesce(1).write.parquet(folder)
            # rows are those of the merged shards: no pass over the new file is needed to know them
            files = self._files(folder)
            return [Shard(p, n, sum(s.rows for s in group)) for p, n in files] if len(files) == 1 else self._written(folder)

        with ThreadPoolExecutor(BESIDE) as pool:
            new = [s for made in pool.map(merge, groups) for s in made]
        return self.commit(old, new, [s for g in groups for s in g], old.meta["schema"]).version

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Remove shards that none of the last ``keep`` versions lists, and manifests that none of those needs; how many shards went.

        Files younger than so many hours are spared.
        """
        files, data = [], self._path(f"{self.uri}/data")
        if self._fs.exists(data):
            found = self._fs.listFiles(data, True)
            while found.hasNext():
                x = found.next()
                if x.getPath().getName().endswith(".parquet"):
                    files.append((x.getPath().toString(), x.getModificationTime()))
        gone = self.log.unlisted(files, keep, hours)
        for path in gone:
            self._fs.delete(self._path(path), False)
        self.log.forget(keep)
        return len(gone)


def compacted(df: DataFrame, uri: str, arrival: Column | None = None, target: int = TARGET) -> Store:
    """A store of the rows, appended by arrivals and compacted until no tier is due. All versions can be read until a vacuum."""
    store = Store(df.sparkSession, uri, target)
    store.append(df, arrival)
    while store.compact():
        pass
    return store

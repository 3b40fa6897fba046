"""A log of versions: which entries (files or folders) a table consists of, changed one whole version at a time.

A version is a JSON file with the next number that says what it adds and removes. It's written aside and renamed into place
without overwriting, so that a reader sees a whole version or none of it, and of two writers one fails and can try again.
Once in a while a version also lists all entries, when as many versions as there are entries have passed since the last
list: reading and writing cost no more than the entries themselves, however many versions there are. On file systems whose
rename can overwrite (object stores) the folder needs a store with conditional writes.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Versions between two lists at least.
LIST_EVERY = 16


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class State(NamedTuple):
    """What holds at a version. entries: path to its values; meta: what else is kept; listed: the last version that lists all entries."""

    version: int
    entries: dict[str, list]
    meta: dict
    listed: int


class Log:
    """The versions in a folder, by the file system of its URI."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder.rstrip("/")
        self.fs = self._at(self.folder).getFileSystem(self._conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _name(self, version: int) -> str:
        return f"{self.folder}/v{version:08d}.json"

    def versions(self) -> list[int]:
        if not self.fs.exists(self._at(self.folder)):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._at(self.folder))]
        return sorted(int(n[1:-5]) for n in names if n[0] == "v" and n.endswith(".json"))

    def _read(self, version: int) -> dict:
        stream = self.fs.open(self._at(self._name(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self, version: int | None = None) -> State:
        """What holds at a version, or at the last one; version 0 has nothing."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return State(0, {}, {}, 0)
        steps: list[dict] = []
        for v in range(version, 0, -1):  # back to the last list
            steps.append(self._read(v))
            if steps[-1].get("all") is not None:
                break
        entries = dict(steps[-1]["all"]) if steps[-1].get("all") is not None else {}
        listed = version - len(steps) + 1 if steps[-1].get("all") is not None else 0
        for step in reversed(steps):
            if step.get("all") is None:
                for path in step["remove"]:
                    entries.pop(path, None)
                entries |= step["add"]
        return State(version, entries, steps[0]["meta"], listed)

    def commit(self, old: State, add: dict[str, list], remove: list[str], meta: dict | None = None) -> State:
        """The version after ``old``; Conflict if another writer has made it. ``meta`` is added to what is kept."""
        gone = set(remove)
        entries = {k: v for k, v in old.entries.items() if k not in gone} | add
        new = {"add": add, "remove": remove, "meta": old.meta | (meta or {})}
        whole = old.version + 1 - old.listed >= max(LIST_EVERY, len(entries))
        if whole:
            new["all"] = entries
        self.fs.mkdirs(self._at(self.folder))
        aside = self._at(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, self._at(self._name(old.version + 1)), none)
        except Exception as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {old.version + 1} exists") from error
            raise
        return State(old.version + 1, entries, new["meta"], old.version + 1 if whole else old.listed)

    def unlisted(self, files: list[tuple[str, int]], keep: int = 1, hours: float = 24) -> list[str]:
        """Of files (path, when it was written, in milliseconds), those that belong to no entry of the last ``keep`` versions.

        Files younger than so many hours are spared: another writer may be about to commit them.
        """
        live = {p for v in self.versions()[-keep:] for p in self.state(v).entries}
        last = int(self._jvm.java.lang.System.currentTimeMillis()) - hours * 3_600_000
        own = lambda path: path in live or any(path.startswith(f"{p}/") for p in live)
        return [path for path, written in files if written <= last and not own(path)]

    def forget(self, keep: int = 1) -> None:
        """Remove versions that are needed for none of the last ``keep``."""
        found = self.versions()
        if len(found) > keep:
            first = self.state(found[-keep]).listed
            for v in found:
                if v < first:
                    self.fs.delete(self._at(self._name(v)), False)

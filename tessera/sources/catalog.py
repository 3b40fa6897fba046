"""A persistent catalog: string keys to strings, lists and ints in one JSON file, and table definitions on top of it.

The file is rewritten beside the old one and renamed over it, so a reader sees one state or the other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyarrow import fs
from pyspark.sql import types as T

from tessera.functions.types import SPARK, EngineError, Schema, struct

HEAP, CLUSTERED = "heap", "bplustree"


@dataclass
class Table:
    """A table's definition and the statistics of its last load (None until there was one)."""

    name: str
    schema: Schema
    path: str
    file_type: str = HEAP
    sort_att: str | None = None
    tuple_count: int | None = None
    distinct: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.schema = [(n, k) for n, k in self.schema]
        names = [n for n, _ in self.schema]
        if len(set(names)) < len(names) or not names:
            raise EngineError(f"{self.name}: columns must be there and differ")
        if bad := [k for _, k in self.schema if k not in SPARK]:
            raise EngineError(f"{self.name}: unknown type {bad[0]}")
        if self.file_type == CLUSTERED and self.sort_att not in names:
            raise EngineError(f"{self.name}: no column {self.sort_att} to order by; the table wasn't created")

    def kind(self, att: str) -> str:
        found = dict(reversed(self.schema)).get(att)
        if found is None:
            raise EngineError(f"{self.name} has no column {att}; there are {', '.join(n for n, _ in self.schema)}")
        return found

    def spark_schema(self) -> T.StructType:
        return struct(self.schema)


class Catalog:
    """path: a local path or a URI."""

    def __init__(self, path: str) -> None:
        self._fs, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self._held: dict[str, object] = {}
        if self._fs.get_file_info(self.path).type == fs.FileType.File:
            with self._fs.open_input_stream(self.path) as file:
                self._held = json.loads(file.read())

    def flush(self) -> None:
        self._fs.create_dir(self.path.rpartition("/")[0] or ".", recursive=True)
        aside = f"{self.path}-{uuid.uuid4().hex}"
        with self._fs.open_output_stream(aside) as file:
            file.write(json.dumps(self._held, indent=1, sort_keys=True).encode())
        self._fs.move(aside, self.path)

    def get_string(self, key: str) -> str | None:
        found = self._held.get(key)
        return found if isinstance(found, str) else None

    def get_strings(self, key: str) -> list[str] | None:
        found = self._held.get(key)
        return list(found) if isinstance(found, list) else None

    def get_int(self, key: str) -> int | None:
        found = self._held.get(key)
        return found if isinstance(found, int) else None

    def put(self, key: str, value: str | list[str] | int) -> None:
        self._held[key] = value
        self.flush()

    def put_table(self, table: Table) -> None:
        """Add or replace a table."""
        self._held[f"table:{table.name}"] = asdict(table)
        self.flush()

    def table(self, name: str) -> Table:
        found = self._held.get(f"table:{name}")
        if found is None:
            raise EngineError(f"no table {name}")
        return Table(**found)

    def tables(self) -> dict[str, Table]:
        return {k[6:]: self.table(k[6:]) for k in self._held if k.startswith("table:")}

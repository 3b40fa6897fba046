"""The engine: a catalog of stored tables, SQL over them, loading, and an interactive prompt (``python -m tessera.engine``)."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.types import EngineError, plain
from tessera.plans.parser import Create, parse_sql
from tessera.plans.translate import translated
from tessera.sources.catalog import CLUSTERED, HEAP, Catalog, Table
from tessera.sources.tables import Stored


class Engine:
    """Tables live under ``root``; frames registered with ``register`` can be queried beside them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.catalog = Catalog(f"{self.root}/catalog.json")
        self._frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self._frames[name] = plain(df)

    def stored(self, name: str) -> Stored:
        return Stored(self.spark, self.catalog.table(name))

    def tables(self) -> dict[str, DataFrame]:
        return {n: Stored(self.spark, t).read() for n, t in self.catalog.tables().items()} | self._frames

    def create(self, statement: Create) -> Table:
        if statement.name in self.catalog.tables():
            raise EngineError(f"there is a table {statement.name}")
        kind = CLUSTERED if statement.sort_att else HEAP
        table = Table(statement.name, statement.schema, f"{self.root}/{statement.name}", kind, statement.sort_att)
        self.catalog.put_table(table)
        return table

    def load(self, name: str, path: str) -> Table:
        table = self.stored(name).load(path)
        self.catalog.put_table(table)
        return table

    def sql(self, text: str) -> DataFrame | Table:
        """Run one statement: CREATE gives the table, SELECT its rows."""
        statement = parse_sql(text.strip().removesuffix(";"))
        if isinstance(statement, Create):
            return self.create(statement)
        return translated(statement, self.tables())


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Statements end at a semicolon; the rest of its line is dropped."""
    held: list[str] = []
    for line in lines:
        head, end, _ = line.rstrip("\n").partition(";")
        held.append(head)
        if end:
            yield "\n".join(held)
            held = []


def prompt(engine: Engine, lines: Iterable[str], out=sys.stdout, limit: int = 100) -> None:
    """Run statements until exit or quit; ``load T from FILE`` loads text. Errors are printed, and the prompt goes on."""
    for text in statements(lines):
        words = text.split()
        try:
            if len(words) == 1 and words[0].lower() in ("exit", "quit"):
                engine.catalog.flush()
                print("Catalog saved.", file=out)
                return
            if len(words) == 4 and words[0].lower() == "load" and words[2].lower() == "from":
                table = engine.load(words[1], words[3])
                print(f"{table.name}: {table.tuple_count} rows loaded", file=out)
                continue
            found = engine.sql(text)
            if isinstance(found, Table):
                print(f"{found.name}: {len(found.schema)} columns", file=out)
            else:
                print("|".join(found.columns), file=out)
                for row in found.take(limit):
                    print("|".join(f"{x:.6f}" if isinstance(x, float) else str(x).lower() if isinstance(x, bool) else str(x) for x in row) + "|", file=out)
        except EngineError as error:
            print(f"Error: {error}", file=out)


if __name__ == "__main__":
    prompt(Engine(SparkSession.builder.appName("tessera").getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else "tessera-data"), sys.stdin)

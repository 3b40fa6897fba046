"""A checked SELECT as a DataFrame.

Each table's columns are renamed to alias.column; in the output the dot is an underscore. Conjuncts over one table become filters below the joins; the joins
form a connected chain with every conjunct at the first place that has its columns, so a cross join is made only where
the statement connects two tables by nothing. Catalyst reorders and picks algorithms from there.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import Columns, Expr, column
from tessera.functions.types import schema_of
from tessera.plans.checker import CheckError, check
from tessera.plans.parser import Select


def named(e: Expr, k: int) -> str:
    """Output name: the column's, sum_ or avg_ and the column's, else value_k."""
    if e.op == "att":
        return e.value.replace(".", "_")
    if e.op in ("sum", "avg") and e.args[0].op == "att":
        return f"{e.op}_{named(e.args[0], k)}"
    return f"value_{k}"


def translated(query: Select, tables: Mapping[str, DataFrame]) -> DataFrame:
    """CheckError if the statement isn't right over the tables."""
    errors = check(query, {n: schema_of(df) for n, df in tables.items()})
    if errors:
        raise CheckError(errors)
    parts = []
    for table, alias in query.tables:
        df = tables[table]
        parts.append(df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in df.columns]))
    left = list(query.where)

    def filtered(df: DataFrame) -> DataFrame:
        own = [e for e in left if e.atts() <= set(df.columns)]
        left[:] = [e for e in left if e not in own]
        return df.where(_all(own, df)) if own else df

    parts = [filtered(df) for df in parts]
    out, rest = parts[0], parts[1:]
    while rest:
        k = next((i for i, df in enumerate(rest) if any(_joins(e, out, df) for e in left)), None)
        k = next((i for i, df in enumerate(rest) if any(e.atts() <= {*out.columns, *df.columns} for e in left)), 0) if k is None else k
        df = rest.pop(k)
        own = [e for e in left if e.atts() <= {*out.columns, *df.columns}]
        left = [e for e in left if e not in own]
        out = out.join(df, _condition(own, out, df), "inner") if own else out.crossJoin(df)
    types = Columns(out)
    names = [named(e, k + 1) for k, e in enumerate(query.values)]
    names = [n if names.count(n) == 1 else f"{n}_{k + 1}" for k, n in enumerate(names)]
    aggregates = list(dict.fromkeys(a for e in query.values for a in e.aggregates()))
    if not aggregates and not query.groups:
        return out.select(*[column(e, types).alias(n) for e, n in zip(query.values, names, strict=True)])
    groups = list(dict.fromkeys(query.groups))
    made = [column(a, types).alias(f"__a{i}") for i, a in enumerate(aggregates)] or [F.count(F.lit(1)).alias("__n")]
    out = out.groupBy(*[column(g, types).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(*made)
    inner = {a: F.col(f"__a{i}") for i, a in enumerate(aggregates)} | {g: F.col(f"__g{i}") for i, g in enumerate(groups)}
    return out.select(*[column(e, types, inner).alias(n) for e, n in zip(query.values, names, strict=True)])


def _all(parts: list[Expr], df: DataFrame) -> Column:
    types = Columns(df)
    return reduce(Column.__and__, [column(e, types) for e in parts])


def _condition(parts: list[Expr], a: DataFrame, b: DataFrame) -> Column:
    types = Columns(a, b)
    return reduce(Column.__and__, [column(e, types) for e in parts])


def _joins(e: Expr, a: DataFrame, b: DataFrame) -> bool:
    """Whether it equates something of one side with something of the other."""
    if e.op != "==":
        return False
    x, y = (arg.atts() for arg in e.args)
    one, other = set(a.columns), set(b.columns)
    return bool(x and y) and (x <= one and y <= other or x <= other and y <= one)

"""The relational operators as functions from DataFrames to DataFrames.

Inputs are never collected; each operator adds one logical step and leaves pushdown, pruning and ordering to Catalyst.
Output schemas are declared by the caller as (name, type) pairs, and values are coerced to them. A projection, predicate or
key is an expression's text (see ``functions.expr``). Column names of the two sides of a join must differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import Columns, Expr, column, compared, compiled, day_of, kind, parse, predicate
from tessera.functions.types import INT, EngineError, Schema, TypeMismatch, coerce, kind_of, printed

TRUE = "bool[true]"


def _where(df: DataFrame, text: str) -> DataFrame:
    own = predicate(text, Columns(df))
    return df if own is None else df.where(own)


def _projected(df: DataFrame, projections: Sequence[str], schema: Schema) -> DataFrame:
    if len(projections) != len(schema):
        raise EngineError(f"{len(projections)} projections for {len(schema)} output columns")
    types = Columns(df)
    made = [compiled(p, types) for p in projections]
    return df.select(*[coerce(c, k, want).alias(name) for (c, k), (name, want) in zip(made, schema, strict=True)])


# selection


def selection(df: DataFrame, where: str, projections: Sequence[str], schema: Schema) -> DataFrame:
    """Rows that the predicate accepts, projected."""
    return _projected(_where(df, where), projections, schema)


def key_range(df: DataFrame, key: str, low: object, high: object, ordered: bool = False) -> DataFrame:
    """Rows with low <= key <= high. On a clustered table whole files and row groups are skipped by their statistics.

    Bounds of a key of dates or times are days, each included as a whole.
    """
    own = F.col(f"`{key}`")
    if key in Columns(df).dated:
        first, last = day_of(str(low)), day_of(str(high))
        if first is None or last is None:
            raise EngineError(f"{key}: {low} to {high} are no days")
        return _ordered(df.where(~compared(own, "<", first) & ~compared(own, ">", last)), own, ordered)
    return _ordered(df.where(own.between(F.lit(low), F.lit(high))), own, ordered)


def _ordered(df: DataFrame, by: Column, ordered: bool) -> DataFrame:
    return df.orderBy(by) if ordered else df


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(f"`{key}`") == F.lit(value))


def range_selection(df: DataFrame, key: str, low: object, high: object, where: str, projections: Sequence[str], schema: Schema) -> DataFrame:
    """``selection`` over a closed key range."""
    return selection(key_range(df, key, low, high), where, projections, schema)


# scans


def pages(*parts: DataFrame) -> DataFrame:
    """The rows of several parts of a table, as a bag."""
    return reduce(DataFrame.unionAll, parts)


# joins


def _condition(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> tuple[Column | None, Columns]:
    if clash := sorted(set(left.columns) & set(right.columns)):
        raise EngineError(f"both sides have {', '.join(clash)}")
    both = Columns(left, right)
    parts = []
    for a, b in keys:
        x, y = parse(a), parse(b)
        if x.atts() - set(left.columns) or y.atts() - set(right.columns):
            raise EngineError(f"a key pair is an expression of the left side and one of the right: {a}, {b}")
        parts.append(column(Expr("==", (x, y)), both))
    return (reduce(Column.__and__, parts) if parts else None), both


def hash_join(left: DataFrame, right: DataFrame, final: str, projections: Sequence[str], schema: Schema, keys: Sequence[tuple[str, str]] = (), left_where: str = TRUE, right_where: str = TRUE) -> DataFrame:
    """Inner join on any number of key pairs, each side filtered first, pairs kept if ``final`` holds.

    Catalyst and adaptive execution choose how: a side under the session's broadcast threshold is broadcast, others are
    shuffled, sorted where their hash tables might not fit, and split where a key is hot. No pairs of keys: a join by
    ``final`` alone.
    """
    left, right = _where(left, left_where), _where(right, right_where)
    on, both = _condition(left, right, keys)
    rest = predicate(final, both)
    if on is None:
        joined = left.crossJoin(right) if rest is None else left.join(right, rest, "inner")
    else:
        joined = left.join(right, on if rest is None else on & rest, "inner")
    return _projected(joined, projections, schema)


def merge_join(left: DataFrame, right: DataFrame, final: str, projections: Sequence[str], schema: Schema, key: tuple[str, str], left_where: str = TRUE, right_where: str = TRUE) -> DataFrame:
    """Inner join on one key pair by sorting both filtered sides; groups of any size spill."""
    left, right = _where(left, left_where), _where(right, right_where)
    on, both = _condition(left, right, [key])
    rest = predicate(final, both)
    return _projected(left.join(right.hint("merge"), on if rest is None else on & rest, "inner"), projections, schema)


def join_totals(left: DataFrame, right: DataFrame, aggregates: Sequence[tuple[str, str]], schema: Schema, keys: Sequence[tuple[str, str]] = (), left_where: str = TRUE, right_where: str = TRUE) -> DataFrame:
    """One row of totals (cnt, sum) over the pairs of ``hash_join``, without making them: pairs grow with the square of a key's rows.

    Each side is first aggregated by its keys. A sum is of ints: of an expression of one side, or of a product of an
    expression of one side and one of the other. Sums are exact; a product or a total that its type doesn't hold is an error, as over pairs.
    """
    if len(aggregates) != len(schema):
        raise EngineError(f"{len(aggregates)} aggregates for {len(schema)} output columns")
    _condition(left, right, keys)
    sides = _where(left, left_where), _where(right, right_where)
    own = [(Columns(df), [F.count(F.lit(1)).alias(f"__n{i}")]) for i, df in enumerate(sides)]
    totals = []

    def summed(e: Expr, k: int) -> int | None:
        """The side that an expression is of; its sum and bounds are added to what that side computes."""
        for i, (types, made) in enumerate(own):
            if e.atts() and not e.atts() - set(types):
                c, found = compiled(e, types)
                if found != INT:
                    raise TypeMismatch(f"no exact sum of {found}: {e}")
                made += [F.sum(c.cast("decimal(20,0)")).alias(f"__s{i}_{k}"), F.min(c).alias(f"__min{i}_{k}"), F.max(c).alias(f"__max{i}_{k}")]
                return i
        return None

    for k, (name, text) in enumerate(aggregates):
        e = parse(text)
        if name == "cnt":
            totals.append(F.coalesce(F.sum(F.col("__n0") * F.col("__n1")), F.lit(0)))
        elif name != "sum":
            raise TypeMismatch(f"no total {name}")
        elif (i := summed(e, k)) is not None:
            totals.append(F.sum(F.col(f"__s{i}_{k}") * F.col(f"__n{1 - i}")))
        elif e.op == "*" and {summed(a, k) for a in e.args} == {0, 1}:
            # the products of a key's pairs lie between those of its bounds: if one doesn't fit its type, one of these doesn't
            bounds = [F.col(f"__{a}0_{k}") * F.col(f"__{b}1_{k}") for a in ("min", "max") for b in ("min", "max")]
            totals.append(F.sum(F.when(F.greatest(*bounds).isNotNull(), F.col(f"__s0_{k}") * F.col(f"__s1_{k}"))))
        else:
            raise EngineError(f"neither of one side nor a product of both: {e}")
    grouped = [df.groupBy(*[compiled(pair[i], types)[0].alias(f"__k{i}_{j}") for j, pair in enumerate(keys)]).agg(*made) for i, (df, (types, made)) in enumerate(zip(sides, own, strict=True))]
    on, _ = _condition(*[df.select(*[c for c in df.columns if c.startswith("__k")]) for df in grouped], [(f"[__k0_{j}]", f"[__k1_{j}]") for j in range(len(keys))])
    pairs = grouped[0].crossJoin(grouped[1]) if on is None else grouped[0].join(grouped[1], on, "inner")
    out = pairs.agg(*[c.alias(f"__a{k}") for k, c in enumerate(totals)])
    return out.select(*[coerce(F.col(f"__a{k}"), INT, want).alias(name) for k, (name, want) in enumerate(schema)])


# aggregation


def aggregate(df: DataFrame, aggregates: Sequence[tuple[str, str]], groupings: Sequence[str], where: str, schema: Schema, drop_empty: bool = False) -> DataFrame:
    """Groups of the accepted rows: the groupings come first in the output, then the aggregates (sum, avg, cnt).

    Groups are exact; aggregates are computed at full width and coerced last. Without groupings there is one row, also
    of no input, unless ``drop_empty``.
    """
    if len(groupings) + len(aggregates) != len(schema):
        raise EngineError(f"{len(groupings)} groupings and {len(aggregates)} aggregates for {len(schema)} output columns")
    types = Columns(df)
    keys = [compiled(g, types) for g in groupings]
    made = []
    for name, text in aggregates:
        e = parse(text)
        own = kind(e, types)
        if name == "cnt":
            made.append((F.count(F.lit(1)), INT))
        elif name in ("sum", "avg"):
            made.append((column(Expr(name, (e,)), types), kind(Expr(name, (e,)), types)))
        else:
            raise TypeMismatch(f"no aggregate {name} of {own}")
    rows = _where(df, where)
    inner = [f"__g{i}" for i in range(len(keys))], [f"__a{i}" for i in range(len(made))]
    out = rows.groupBy(*[c.alias(n) for (c, _), n in zip(keys, inner[0], strict=True)]).agg(*[c.alias(n) for (c, _), n in zip([*made, (F.count(F.lit(1)), INT)], [*inner[1], "__n"], strict=True)])
    if drop_empty and not keys:
        out = out.where("__n > 0")
    return out.select(*[coerce(F.col(n), k, want).alias(name) for n, (_, k), (name, want) in zip([*inner[0], *inner[1]], [*keys, *made], schema, strict=True)])


# sort


def _order(df: DataFrame, by: str) -> Column:
    return compiled(by, Columns(df))[0].asc()


def sort(df: DataFrame, by: str, where: str = TRUE) -> DataFrame:
    """Accepted rows in ascending order of an expression; equal keys in any order."""
    return _where(df, where).orderBy(_order(df, by))


def sort_within(df: DataFrame, by: str) -> DataFrame:
    """Each partition in order, without a shuffle."""
    return df.sortWithinPartitions(_order(df, by))


def merge(inputs: Sequence[DataFrame], by: str) -> DataFrame:
    """Several inputs of equal columns as one ordered output."""
    return sort(pages(*inputs), by)


# statistics


def statistics(df: DataFrame, exact: bool = False, error: float = 0.02) -> DataFrame:
    """(column_name, n_distinct, n_rows) in one pass; distinct counts are estimates of this standard error unless ``exact``.

    Exact counts expand each row to one for every column: that is for small tables.
    """
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, error)
    for f in df.schema.fields:
        kind_of(f.dataType)
    df = printed(df)
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[count(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("n_distinct")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(rows).alias("r"), F.col("__n").alias("n_rows")).select("r.column_name", "r.n_distinct", "n_rows")

"""The four scalar types, their promotion, their text form, and coercion to declared output types.

Expressions know ints, doubles, strings and bools. A column can also be declared ``long``: an int of 64 bits, for counts and
sums of large tables. Dates and times are strings to expressions (``yyyy-MM-dd``), but stay dates in the tables, so that
comparisons with days reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT, DOUBLE, STRING, BOOL = "int", "double", "string", "bool"
LONG = "long"
DATED = (T.DateType, T.TimestampType, T.TimestampNTZType)
SPARK = {INT: T.IntegerType(), LONG: T.LongType(), DOUBLE: T.DoubleType(), STRING: T.StringType(), BOOL: T.BooleanType()}
Schema = list[tuple[str, str]]


class EngineError(Exception):
    """What a query or a table definition has wrong."""


class TypeMismatch(EngineError):
    """An operand or an output column has a type that the operation doesn't take."""


def kind_of(spark_type: T.DataType) -> str:
    """The scalar type of a Spark type. Wide integers are ints, dates and times are strings."""
    if isinstance(spark_type, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return INT
    if isinstance(spark_type, (T.DoubleType, T.FloatType)):
        return DOUBLE
    if isinstance(spark_type, (T.StringType, *DATED)):
        return STRING
    if isinstance(spark_type, T.BooleanType):
        return BOOL
    raise TypeMismatch(f"{spark_type.simpleString()} is none of the engine's types")


def plain(df: DataFrame) -> DataFrame:
    """The table with decimals as doubles; other columns stay, dates and times too."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def day(column: Column) -> Column:
    """A date or time as the engine prints it."""
    return F.date_format(column, "yyyy-MM-dd")


def printed(df: DataFrame) -> DataFrame:
    """The table with dates and times as text: what the engine gives out."""
    return plain(df).select(*[day(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, DATED) else F.col(f"`{f.name}`") for f in plain(df).schema.fields])


def to_text(column: Column, kind: str) -> Column:
    """Text as the engine prints it: doubles have six decimals."""
    return F.format_string("%.6f", column) if kind == DOUBLE else column if kind == STRING else column.cast("string")


def to_double(column: Column, kind: str) -> Column:
    if kind not in (INT, DOUBLE):
        raise TypeMismatch(f"{kind} is no number")
    return column.cast("double")


def coerce(column: Column, kind: str, declared: str) -> Column:
    """A value stored into a column of the declared type. Doubles lose their fraction in an int; any type has a text."""
    if declared not in SPARK:
        raise TypeMismatch(f"unknown type {declared}")
    if declared == STRING:
        return to_text(column, kind)
    if declared == BOOL or kind == BOOL:
        if kind != declared:
            raise TypeMismatch(f"{kind} can't be stored as {declared}")
        return column
    if kind == STRING:
        raise TypeMismatch(f"{kind} can't be stored as {declared}")
    return column.cast(SPARK[declared])


def struct(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[k]) for n, k in schema])


def schema_of(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}

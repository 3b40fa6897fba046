import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.expr import Columns, Expr, compiled, kind, parse, predicate
from tessera.functions.types import EngineError, TypeMismatch, coerce
from pyspark.sql import functions as F

ROW = {"i": 7, "j": -3, "d": 2.5, "e": 4192.4, "s": "abc", "t": "7", "b": True, "c": False}


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([tuple(ROW.values())], "i int, j int, d double, e double, s string, t string, b boolean, c boolean")


def value(df, text):
    column, _ = compiled(text, Columns(df))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("+ ([i], [j])", 4), ("+ ([i], [d])", 9.5), ("+ ([i], [s])", "7abc"), ("+ ([e], [s])", "4192.400000abc"), ("+ ([b], [c])", "truefalse"), ("+ ([b], [i])", "true7"),
        ("- ([i], [j])", 10), ("- ([d], [i])", -4.5), ("* ([i], [j])", -21), ("* ([i], [d])", 17.5), ("/ ([i], [j])", -2), ("/ ([j], int[2])", -1), ("/ ([i], double[2])", 3.5),
        ("um ([i])", -7), ("um ([d])", -2.5), ("> ([i], [j])", True), ("> ([i], [t])", False), ("< ([d], [i])", True), ("> ([s], [t])", True), ("< ([b], [c])", False),
        ("== ([i], [t])", True), ("== ([b], [c])", False), ("!= ([s], string[abc])", False), ("|| ([b], [c])", True), ("&& ([b], [c])", False), ("! ([c])", True),
        ("int[5]", 5), ("double[1.25]", 1.25), ("bool[true]", True), ("bool[TRUE]", False), ("string[a b, c (d)]", "a b, c (d)"), (" )) +\n( [i] ,, [j] )", 4), ("== ([b], string[true])", True),
    ],
)
def test_values(one, text, expected):
    assert value(one, text) == expected


@pytest.mark.parametrize("text", ["- ([s], [i])", "* ([b], [i])", "/ ([s], [s])", "um ([s])", "um ([b])", "|| ([i], [b])", "&& ([b], [s])", "! ([i])"])
def test_type_errors(one, text):
    with pytest.raises(TypeMismatch):
        compiled(text, Columns(one))


@pytest.mark.parametrize("text", ["+ ([i]", "", "[nope]", "int[x]", "sum([i])", "avg ([i])", "+ ([i], int[])"])
def test_other_errors(one, text):
    with pytest.raises(EngineError):
        compiled(text, Columns(one))


def test_every_pair_of_types():
    names = ["int", "double", "string", "bool"]
    schema = {n: n for n in names}
    for a, b in itertools.product(names, names):
        assert kind(parse(f"+ ([{a}], [{b}])"), schema) == ("int" if {a, b} == {"int"} else "double" if {a, b} <= {"int", "double"} else "string")
        for op in (">", "<", "==", "!="):
            assert kind(parse(f"{op} ([{a}], [{b}])"), schema) == "bool"
        for op in "-*/":
            if {a, b} <= {"int", "double"}:
                assert kind(parse(f"{op} ([{a}], [{b}])"), schema) == ("int" if {a, b} == {"int"} else "double")
            else:
                with pytest.raises(TypeMismatch):
                    kind(parse(f"{op} ([{a}], [{b}])"), schema)


def test_predicate(one):
    assert predicate("bool[true]", Columns(one)) is None
    with pytest.raises(TypeMismatch):
        predicate("[i]", Columns(one))


def test_coercion(one):
    get = lambda text, to: one.select(coerce(*compiled(text, Columns(one)), to).alias("x")).first()["x"]
    assert get("double[3.9]", "int") == 3 and get("double[-3.9]", "int") == -3
    assert get("[i]", "double") == 7.0 and get("[e]", "string") == "4192.400000" and get("[b]", "string") == "true"
    for text, to in (("[s]", "int"), ("[b]", "int"), ("[i]", "bool"), ("[s]", "double"), ("[s]", "bool")):
        with pytest.raises(TypeMismatch):
            get(text, to)


leaf = st.one_of(st.integers(-99, 99).map(lambda n: Expr("int", value=n)), st.sampled_from(["i", "j"]).map(lambda n: Expr("att", value=n)))
tree = st.recursive(leaf, lambda x: st.tuples(st.sampled_from(["+", "-", "*"]), x, x).map(lambda t: Expr(t[0], t[1:])), max_leaves=6)


def evaluated(e):
    if e.op == "int":
        return e.value
    if e.op == "att":
        return ROW[e.value]
    a, b = map(evaluated, e.args)
    return {"+": a + b, "-": a - b, "*": a * b}[e.op]


@settings(max_examples=15, deadline=None)
@given(st.lists(tree, min_size=1, max_size=8))
def test_text_and_values_of_random_trees(spark, trees):
    df = spark.createDataFrame([tuple(ROW.values())], "i long, j long, d double, e double, s string, t string, b boolean, c boolean")
    assert [parse(str(t)) for t in trees] == trees
    row = df.select(*[compiled(t, Columns(df))[0].cast("bigint").alias(f"x{k}") for k, t in enumerate(trees) if abs(evaluated(t)) < 1 << 31]).first()
    assert list(row) == [evaluated(t) for t in trees if abs(evaluated(t)) < 1 << 31]


def test_fixed_literal_is_typed(one):
    assert one.select(F.lit(1)).count() == 1 and kind(parse("int[1]"), {}) == "int"

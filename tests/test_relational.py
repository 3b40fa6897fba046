import pytest

from tessera.functions.types import EngineError, TypeMismatch
from tessera.operators import relational as R
from tessera.queries import prefixed, table

TRUE = R.TRUE


@pytest.fixture(scope="module")
def s(spark, sf_dir):
    return table(spark, sf_dir, "supplier")


@pytest.fixture(scope="module")
def c(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


NAMES = ["[s_name]", "[c_name]"], [("s", "string"), ("c", "string")]


def test_joins_agree_and_use_their_algorithms(s, c):
    hashed = R.hash_join(s, c, "> ([c_acctbal], [s_acctbal])", *NAMES, [("[s_nationkey]", "[c_nationkey]")], "< ([s_nationkey], int[9])", "> ([c_acctbal], int[0])")
    merged = R.merge_join(s, c, "> ([c_acctbal], [s_acctbal])", *NAMES, ("[s_nationkey]", "[c_nationkey]"), "< ([s_nationkey], int[9])", "> ([c_acctbal], int[0])")
    theta = R.hash_join(s, c, "&& (== ([s_nationkey], [c_nationkey]), > ([c_acctbal], [s_acctbal]))", *NAMES, (), "< ([s_nationkey], int[9])", "> ([c_acctbal], int[0])")
    expected = sorted((a.s_name, b.c_name) for a in s.collect() for b in c.collect() if a.s_nationkey == b.c_nationkey < 9 and b.c_acctbal > 0 and b.c_acctbal > a.s_acctbal)
    assert rows(hashed) == rows(merged) == rows(theta) == expected
    assert "BroadcastHashJoin" in plan(hashed) and "SortMergeJoin" in plan(merged)
    assert "BroadcastNestedLoopJoin" in plan(R.hash_join(s, c, "< ([s_acctbal], [c_acctbal])", *NAMES)) or "CartesianProduct" in plan(R.hash_join(s, c, "< ([s_acctbal], [c_acctbal])", *NAMES))


def test_small_sides_are_broadcast(s, c):
    assert "BuildLeft" in plan(R.hash_join(s, c, TRUE, *NAMES, [("[s_nationkey]", "[c_nationkey]")]))
    assert "BuildRight" in plan(R.hash_join(c, s, TRUE, *NAMES, [("[c_nationkey]", "[s_nationkey]")]))


def test_small_tables_of_many_are_broadcast(spark, sf_dir):
    from tessera.queries import join_nway_q5

    text = plan(join_nway_q5(spark, sf_dir))
    assert text.count("BroadcastHashJoin") >= 4 and "ShuffledHashJoin" not in text


def test_a_large_side_is_shuffled(spark, s, c):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.hash_join(s, c, TRUE, *NAMES, [("[s_nationkey]", "[c_nationkey]")])
        assert "SortMergeJoin" in plan(out) and out.count() == sum(a.s_nationkey == b.c_nationkey for a in s.collect() for b in c.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_totals_of_pairs_are_those_of_the_join(spark, s, c):
    keys, only = [("[s_nationkey]", "[c_nationkey]")], ("< ([s_nationkey], int[9])", "> ([c_acctbal], int[0])")
    for on, where in ((keys, only), (keys, (TRUE, TRUE)), ((), only), (keys, ("< ([s_suppkey], int[-1])", TRUE))):
        sums = ["* ([c_custkey], - ([s_suppkey], int[3]))", "[c_custkey]", "* ([s_suppkey], [s_suppkey])"]
        pairs = R.hash_join(s, c, TRUE, sums, [("a", "long"), ("b", "long"), ("d", "long")], on, *where)
        expected = R.aggregate(pairs, [("cnt", "int[0]"), ("sum", "[a]"), ("sum", "[b]"), ("sum", "[d]")], [], TRUE, [(x, "long") for x in "nabd"])
        totals = R.join_totals(s, c, [("cnt", "int[0]"), *(("sum", x) for x in sums)], [(x, "long") for x in "nabd"], on, *where)
        assert rows(totals) == rows(expected) and totals.dtypes == expected.dtypes
    for wrong in ("* ([s_suppkey], [s_acctbal])", "+ ([s_suppkey], [c_custkey])", "[s_name]"):
        with pytest.raises(EngineError):
            R.join_totals(s, c, [("sum", wrong)], [("x", "long")], keys)


def test_totals_of_pairs_with_nulls_and_overflow(spark):
    a = spark.createDataFrame([(1, 5), (1, None), (None, 7), (2, None), (3, 1)], "k int, x bigint")
    b = spark.createDataFrame([(1, 10), (1, 20), (None, 1), (2, 4), (4, 1)], "j int, y bigint")
    made = lambda a, b: rows(R.join_totals(a, b, [("cnt", "int[0]"), ("sum", "* ([x], [y])"), ("sum", "[y]")], [(n, "long") for n in ("n", "p", "y")], [("[k]", "[j]")]))
    assert made(a, b) == [(5, 150, 64)]
    assert made(a.where("k = 2"), b) == [(1, None, 4)]
    big = spark.createDataFrame([(1, 1 << 62), (1, 1 << 62), (1, -(1 << 62)), (1, -(1 << 62)), (1, 9)], "k int, x bigint")
    one = spark.createDataFrame([(1, 1)], "j int, y bigint")
    assert made(big, one) == [(5, 9, 5)]  # the total fits, whatever the order
    for other in (one.selectExpr("j", "2 * y AS y"), one.selectExpr("j", "-4 * y AS y")):
        with pytest.raises(Exception, match="OVERFLOW"):
            made(big, other)  # a pair's product doesn't
    with pytest.raises(Exception, match="OVERFLOW"):
        made(big.where("x > 0"), one)


def test_wide_totals_of_many_rows_of_a_key(spark, tmp_path):
    """Before, each of 10^11 pairs was made."""
    from tessera.queries import join_wide_totals

    n = 320_000
    spark.range(n).selectExpr("id % 7 AS c_custkey", "cast(0 as int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert rows(join_wide_totals(spark, str(tmp_path))) == [(n * n, sum(i % 7 for i in range(n)) ** 2)]


def test_days_reach_the_scan(spark, sf_dir):
    from tessera.queries import QUERIES, sql

    days = sql(spark, sf_dir, 'SELECT o.o_orderkey FROM orders AS o WHERE o.o_orderdate > "1996-01-01" AND o.o_orderdate < "1997-01-01"')
    assert "GreaterThanOrEqual(o_orderdate,1996-01-02" in plan(days) and "LessThan(o_orderdate,1" in plan(days)
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in plan(QUERIES["range_clustered"](spark, sf_dir))


def test_days_compare_as_their_text(spark):
    times = ["1999-12-31 23:59:59", "2000-01-01 00:00:00", "2000-01-01 12:30:00", "2000-01-02 00:00:00", None]
    for kind in ("date", "timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr(f"cast(t as {kind}) as d", "substring(t, 1, 10) as e")
        for sign, value in ((x, v) for x in (">", "<", "==", "!=") for v in ("2000-01-01", "2000-1-1", "x", "1999-12-31", "2000-02-30")):
            for a, b in (("[{}]", f"string[{value}]"), (f"string[{value}]", "[{}]")):
                one, other = (R.selection(df, f"{sign} ({a.format(x)}, {b.format(x)})", ["[e]"], [("e", "string")]) for x in "de")
                assert rows(one) == rows(other), (kind, sign, a, b)
        assert R.selection(df, "== ([d], [e])", ["[d]"], [("d", "string")]).where("d is not null").count() == 4
        assert R.hash_join(prefixed(df, "l_"), prefixed(df, "r_"), TRUE, ["[l_e]"], [("e", "string")], [("[l_d]", "[r_d]")]).count() == 6
        assert R.key_range(df, "d", "2000-01-01", "2000-01-01").count() == 2


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    out = R.selection(spark.read.parquet(f"{sf_dir}/part.parquet"), "> ([p_size], int[40])", ["[p_name]"], [("n", "string")])
    text = plan(out)
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,40)]" in text and "ReadSchema: struct<p_name:string,p_size:int>" in text


def test_clashing_columns_and_bad_keys(s, c):
    with pytest.raises(EngineError):
        R.hash_join(s, s, TRUE, [], [], [("[s_name]", "[s_name]")])
    with pytest.raises(EngineError):
        R.hash_join(s, c, TRUE, *NAMES, [("[c_nationkey]", "[s_nationkey]")])


def test_self_join_and_mixed_type_keys(s):
    got = R.hash_join(prefixed(s, "l_"), prefixed(s, "r_"), TRUE, ["[l_s_name]"], [("n", "string")], [("[l_s_suppkey]", "+ ([r_s_suppkey], string[])")])
    assert got.count() == s.count()


def test_join_of_an_empty_side(s, c):
    assert R.merge_join(s, c, TRUE, *NAMES, ("[s_nationkey]", "[c_nationkey]"), right_where="bool[false]").count() == 0


def test_groups_are_exact(spark):
    df = spark.createDataFrame([(1, 1, 1.25), (2, 2, 1.75), (1, 2, 0.5), (2, 1, 0.25)], "a int, b int, d double")
    assert rows(R.aggregate(df, [("cnt", "int[0]")], ["[a]", "[b]"], TRUE, [("a", "int"), ("b", "int"), ("n", "int")])) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    assert len(rows(R.aggregate(df, [("cnt", "int[0]")], ["[d]"], TRUE, [("d", "double"), ("n", "int")]))) == 4
    assert rows(R.aggregate(df, [("sum", "[d]"), ("avg", "[d]"), ("sum", "[d]")], [], TRUE, [("x", "double"), ("y", "double"), ("z", "int")])) == [(3.75, 0.9375, 3)]


def test_aggregate_arity_types_and_empty_input(s):
    with pytest.raises(EngineError):
        R.aggregate(s, [("cnt", "int[0]")], [], TRUE, [])
    with pytest.raises(TypeMismatch):
        R.aggregate(s, [("sum", "[s_name]")], [], TRUE, [("x", "int")])
    with pytest.raises(TypeMismatch):
        R.aggregate(s, [("max", "[s_suppkey]")], [], TRUE, [("x", "int")])
    none = [("cnt", "int[0]")], [], "bool[false]", [("n", "int")]
    assert rows(R.aggregate(s, *none)) == [(0,)] and rows(R.aggregate(s, *none, drop_empty=True)) == []


def test_thirty_two_copies(spark, s):
    big = R.pages(*[s] * 32)
    for low, high in ((0, 3), (5, 5), (2, 9), (8, 100)):
        found = sum(low <= r.s_suppkey <= high for r in s.collect())
        assert R.key_range(big, "s_suppkey", low, high).count() == 32 * found
        ordered = [r.s_suppkey for r in R.key_range(big, "s_suppkey", low, high, ordered=True).collect()]
        assert ordered == sorted(ordered) and len(ordered) == 32 * found


def test_sort(c):
    by = [r.c_acctbal for r in R.sort(c, "[c_acctbal]", "> ([c_nationkey], int[3])").collect()]
    assert by == sorted(by)
    down = [r.c_acctbal for r in R.sort(c, "um ([c_acctbal])").collect()]
    assert down == sorted(down, reverse=True)
    merged = [r.c_acctbal for r in R.merge([R.sort(c, "[c_acctbal]")] * 3, "[c_acctbal]").collect()]
    assert merged == sorted(merged) and len(merged) == 3 * len(down)


def test_projection_arity(s):
    with pytest.raises(EngineError):
        R.selection(s, TRUE, ["[s_name]"], [])


def test_statistics(s):
    exact = {r.column_name: (r.n_distinct, r.n_rows) for r in R.statistics(s, exact=True).collect()}
    about = {r.column_name: r.n_distinct for r in R.statistics(s).collect()}
    for name, (n, total) in exact.items():
        assert total == s.count() and abs(about[name] - n) <= max(2, 0.15 * n)

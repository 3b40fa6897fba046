"""The registered queries over the relational operators and the SQL dialect, each with its plain SQL."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine, prompt
from tessera.functions.types import plain, printed, schema_of
from tessera.operators import relational as R
from tessera.plans.checker import check
from tessera.plans.parser import parse_sql
from tessera.plans.translate import translated
from tessera.sources.catalog import CLUSTERED, HEAP, Table
from tessera.sources.folders import scratch
from tessera.sources.tables import Stored, as_lines, clustered, read_text, write_text
from tessera.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRUE = R.TRUE


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


# selection


@query("SELECT s_name, CAST(s_nationkey AS VARCHAR) AS nation, s_name || ' ' || printf('%.6f', s_acctbal) AS combined FROM supplier WHERE s_nationkey = 1")
def sel_filter_project(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "supplier"), "== ([s_nationkey], int[1])", ["[s_name]", "[s_nationkey]", "+ (+ ([s_name], string[ ]), [s_acctbal])"], [("s_name", "string"), ("nation", "string"), ("combined", "string")])


@query("SELECT s_name, s_acctbal FROM supplier WHERE s_nationkey < 5 AND s_name > 'Supplier#000000040'")
def sel_string_cmp(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "supplier"), "&& (< ([s_nationkey], int[5]), > ([s_name], string[Supplier#000000040]))", ["[s_name]", "[s_acctbal]"], [("s_name", "string"), ("s_acctbal", "double")])


@query("""SELECT CAST(l_orderkey AS INT) AS k, l_linenumber + 1 AS plus_i, l_quantity + 1 AS plus_d, l_returnflag || 'x' AS plus_s, l_linenumber - 2 AS minus_i,
l_quantity - 0.5 AS minus_d, l_linenumber * 3 AS times_i, l_quantity * 1.5 AS times_d, l_linenumber // 2 AS div_i, l_quantity / 4 AS div_d, -l_linenumber AS neg_i,
-l_quantity AS neg_d, l_linenumber > 2 AS gt, l_quantity < 20 AS lt, l_returnflag = 'N' AS eq, l_linestatus <> 'O' AS ne, l_linenumber > 2 OR l_quantity < 20 AS disj,
l_linenumber > 2 AND l_quantity < 20 AS conj, NOT (l_linenumber > 2) AS nt, 7 AS c_int, 1.5::DOUBLE AS c_double, true AS c_bool, 'lit' AS c_string FROM lineitem""")
def sel_all_expr_ops(spark, sf_dir):
    i, q = "[l_linenumber]", "[l_quantity]"
    made = [
        ("k", "int", "[l_orderkey]"), ("plus_i", "int", f"+ ({i}, int[1])"), ("plus_d", "double", f"+ ({q}, int[1])"), ("plus_s", "string", "+ ([l_returnflag], string[x])"),
        ("minus_i", "int", f"- ({i}, int[2])"), ("minus_d", "double", f"- ({q}, double[0.5])"), ("times_i", "int", f"* ({i}, int[3])"), ("times_d", "double", f"* ({q}, double[1.5])"),
        ("div_i", "int", f"/ ({i}, int[2])"), ("div_d", "double", f"/ ({q}, int[4])"), ("neg_i", "int", f"um ({i})"), ("neg_d", "double", f"um ({q})"),
        ("gt", "bool", f"> ({i}, int[2])"), ("lt", "bool", f"< ({q}, int[20])"), ("eq", "bool", "== ([l_returnflag], string[N])"), ("ne", "bool", "!= ([l_linestatus], string[O])"),
        ("disj", "bool", f"|| (> ({i}, int[2]), < ({q}, int[20]))"), ("conj", "bool", f"&& (> ({i}, int[2]), < ({q}, int[20]))"), ("nt", "bool", f"! (> ({i}, int[2]))"),
        ("c_int", "int", "int[7]"), ("c_double", "double", "double[1.5]"), ("c_bool", "bool", "bool[true]"), ("c_string", "string", "string[lit]"),
    ]
    return R.selection(table(spark, sf_dir, "lineitem"), TRUE, [e for _, _, e in made], [(n, k) for n, k, _ in made])


@query("SELECT CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey // 100 AS INT) AS bucket, CAST(-o_custkey // 7 AS INT) AS below FROM orders")
def sel_int_division(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "orders"), TRUE, ["[o_orderkey]", "/ ([o_custkey], int[100])", "/ (um ([o_custkey]), int[7])"], [("o_orderkey", "int"), ("bucket", "int"), ("below", "int")])


@query("SELECT CAST(l_orderkey AS INT) AS l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_returnflag = 'R') AND NOT l_linenumber < 3")
def sel_bool_logic(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "lineitem"), "&& (|| (> ([l_quantity], int[45]), == ([l_returnflag], string[R])), ! (< ([l_linenumber], int[3])))", ["[l_orderkey]", "[l_linenumber]"], [("l_orderkey", "int"), ("l_linenumber", "int")])


@query("""SELECT CAST(c_custkey AS INT) AS c_custkey, CAST(c_custkey AS VARCHAR) > '5' AS int_gt, printf('%.6f', c_acctbal) < '3' AS double_lt, CAST(c_custkey AS VARCHAR) = '17' AS int_eq,
CAST(c_custkey > 9 AS VARCHAR) <> 'true' AS bool_ne, CAST(c_nationkey AS VARCHAR) || CAST(c_nationkey > 3 AS VARCHAR) AS int_bool FROM customer WHERE CAST(c_custkey AS VARCHAR) < '7'""")
def sel_mixed_type_cmp(spark, sf_dir):
    made = [("c_custkey", "int", "[c_custkey]"), ("int_gt", "bool", "> ([c_custkey], string[5])"), ("double_lt", "bool", "< ([c_acctbal], string[3])"), ("int_eq", "bool", "== ([c_custkey], string[17])"), ("bool_ne", "bool", "!= (> ([c_custkey], int[9]), string[true])"), ("int_bool", "string", "+ ([c_nationkey], > ([c_nationkey], int[3]))")]
    return R.selection(table(spark, sf_dir, "customer"), "< ([c_custkey], string[7])", [e for _, _, e in made], [(n, k) for n, k, _ in made])


@query("""SELECT CAST(l_orderkey AS INT) AS l_orderkey, CAST(trunc(l_extendedprice) AS INT) AS price, printf('%.6f', l_discount) AS discount, CAST(l_linenumber AS DOUBLE) AS line,
CAST(l_quantity > 25 AS VARCHAR) AS many FROM lineitem""")
def sel_output_coercion(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "lineitem"), TRUE, ["[l_orderkey]", "[l_extendedprice]", "[l_discount]", "[l_linenumber]", "> ([l_quantity], int[25])"], [("l_orderkey", "int"), ("price", "int"), ("discount", "string"), ("line", "double"), ("many", "string")])


@query("SELECT r_name FROM region")
def sel_trivial_predicate(spark, sf_dir):
    return R.selection(table(spark, sf_dir, "region"), TRUE, ["[r_name]"], [("r_name", "string")])


# ranges


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999")
def range_closed(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders"), "o_orderkey", 1000, 1999).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 10 AND 99")
def range_sorted(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders"), "o_custkey", 10, 99, ordered=True).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77")
def range_point(spark, sf_dir):
    return R.point(table(spark, sf_dir, "orders"), "o_custkey", 77).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN -20 AND -10")
def range_empty(spark, sf_dir):
    return R.key_range(table(spark, sf_dir, "orders"), "o_orderkey", -20, -10).select("o_orderkey")


@query("SELECT p_name, p_brand || ' ' || p_type AS what FROM part WHERE p_partkey BETWEEN 100 AND 900 AND p_size > 25")
def range_residual(spark, sf_dir):
    return R.range_selection(table(spark, sf_dir, "part"), "p_partkey", 100, 900, "> ([p_size], int[25])", ["[p_name]", "+ (+ ([p_brand], string[ ]), [p_type])"], [("p_name", "string"), ("what", "string")])


@query("SELECT o_orderkey, o_orderdate FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders) WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-03-31'")
def range_clustered(spark, sf_dir):
    return printed(R.key_range(clustered(table(spark, sf_dir, "orders"), "o_orderdate"), "o_orderdate", "1996-01-01", "1996-03-31").select("o_orderkey", "o_orderdate"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1997-12-30' AND strftime(o_orderdate, '%Y-%m-%d') < '1998-02-01' AND strftime(o_orderdate, '%Y-%m-%d') <> '1998-01-15'")
def range_days(spark, sf_dir):
    where = "&& (&& (> ([o_orderdate], string[1997-12-30]), > (string[1998-02-01], [o_orderdate])), != ([o_orderdate], string[1998-01-15]))"
    return R.selection(table(spark, sf_dir, "orders"), where, ["[o_orderkey]", "[o_orderdate]"], [("o_orderkey", "long"), ("day", "string")])


# joins


@query("SELECT c_name, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9000 AND s_acctbal < 0")
def join_hash_1key(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), TRUE, ["[c_name]", "[s_name]"], [("c_name", "string"), ("s_name", "string")], [("[c_nationkey]", "[s_nationkey]")], "> ([c_acctbal], int[9000])", "< ([s_acctbal], int[0])")


@query("""SELECT CAST(a.l_orderkey AS INT) AS k, CAST(a.l_partkey AS INT) AS p1, CAST(b.l_partkey AS INT) AS p2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_linenumber < b.l_linenumber""")
def join_hash_2key(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")  # noqa: E741
    return R.hash_join(prefixed(l, "a_"), prefixed(l, "b_"), "< ([a_l_linenumber], [b_l_linenumber])", ["[a_l_orderkey]", "[a_l_partkey]", "[b_l_partkey]"], [("k", "int"), ("p1", "int"), ("p2", "int")],
                       [("[a_l_orderkey]", "[b_l_orderkey]"), ("[a_l_suppkey]", "[b_l_suppkey]")], "== ([a_l_returnflag], string[R])", "== ([b_l_returnflag], string[A])")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey + 4")
def join_hash_expr_key(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), TRUE, ["[n_name]", "[r_name]"], [("n_name", "string"), ("r_name", "string")], [("[n_nationkey]", "+ ([r_regionkey], int[4])")])


@query("SELECT n_name, s_name FROM nation JOIN supplier ON CAST(n_nationkey AS VARCHAR) || '' = CAST(s_nationkey AS VARCHAR)")
def join_hash_mixed_key(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), TRUE, ["[n_name]", "[s_name]"], [("n_name", "string"), ("s_name", "string")], [("+ ([n_nationkey], string[])", "[s_nationkey]")])


@query("SELECT CAST(o_orderkey AS INT) AS o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > c_acctbal * 40")
def join_residual_theta(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "> ([o_totalprice], * ([c_acctbal], int[40]))", ["[o_orderkey]", "[c_name]"], [("o_orderkey", "int"), ("c_name", "string")], [("[o_custkey]", "[c_custkey]")])


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
def join_theta_only(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "< ([n_regionkey], [r_regionkey])", ["[n_name]", "[r_name]"], [("n_name", "string"), ("r_name", "string")])


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(spark, sf_dir):
    return R.hash_join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), TRUE, ["[n_name]", "[r_name]"], [("n_name", "string"), ("r_name", "string")])


@query("SELECT s_name, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > 5000 AND c_acctbal < 0")
def join_smj(spark, sf_dir):
    return R.merge_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), TRUE, ["[s_name]", "[c_name]"], [("s_name", "string"), ("c_name", "string")], ("[s_nationkey]", "[c_nationkey]"), "> ([s_acctbal], int[5000])", "< ([c_acctbal], int[0])")


@query("SELECT s_nationkey AS nation, CAST(count(*) AS INT) AS mycnt FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_nationkey < 8 AND c_acctbal > s_acctbal GROUP BY s_nationkey")
def join_smj_groups(spark, sf_dir):
    out = R.merge_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), "> ([c_acctbal], [s_acctbal])", ["[s_name]", "[s_nationkey]"], [("name", "string"), ("nation", "int")], ("[s_nationkey]", "[c_nationkey]"), "< ([s_nationkey], int[8])")
    return R.aggregate(out, [("cnt", "int[0]")], ["[nation]"], TRUE, [("nation", "int"), ("mycnt", "int")])


@query("SELECT count(*) AS pairs, CAST(sum(CAST(c1.c_custkey AS BIGINT) * c2.c_custkey) AS BIGINT) AS total FROM customer c1 JOIN customer c2 ON c1.c_nationkey = c2.c_nationkey")
def join_wide_totals(spark, sf_dir):
    """Totals that 32 bits don't hold."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return R.join_totals(prefixed(c, "l_"), prefixed(c, "r_"), [("cnt", "int[0]"), ("sum", "* ([l_c_custkey], [r_c_custkey])")], [("pairs", "long"), ("total", "long")], [("[l_c_nationkey]", "[r_c_nationkey]")])


@query("SELECT a.s_name AS one, b.s_name AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_name < b.s_name")
def join_self(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return R.hash_join(prefixed(s, "l_"), prefixed(s, "r_"), "< ([l_s_name], [r_s_name])", ["[l_s_name]", "[r_s_name]"], [("one", "string"), ("other", "string")], [("[l_s_nationkey]", "[r_s_nationkey]")])


@query("SELECT CAST(count(*) AS INT) AS mycnt FROM customer c1 JOIN customer c2 ON c1.c_nationkey = c2.c_nationkey WHERE c1.c_nationkey < 2")
def join_many_to_many_count(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_name")
    out = R.hash_join(prefixed(c, "l_"), prefixed(c, "r_"), TRUE, ["[l_c_name]"], [("name", "string")], [("[l_c_nationkey]", "[r_c_nationkey]")], "< ([l_c_nationkey], int[2])")
    return R.aggregate(out, [("cnt", "int[0]")], [], TRUE, [("mycnt", "int")])


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_totalprice > 1000 GROUP BY n_name""")
def join_nway_q5(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    keep = lambda *names: ([f"[{n}]" for n, _ in names], list(names))
    nr = R.hash_join(t("nation"), t("region"), TRUE, *keep(("n_nationkey", "int"), ("n_name", "string")), [("[n_regionkey]", "[r_regionkey]")], right_where="== ([r_name], string[ASIA])")
    sn = R.hash_join(t("supplier"), nr, TRUE, *keep(("s_suppkey", "int"), ("s_nationkey", "int"), ("n_name", "string")), [("[s_nationkey]", "[n_nationkey]")])
    co = R.hash_join(t("orders"), t("customer"), TRUE, *keep(("o_orderkey", "int"), ("c_nationkey", "int")), [("[o_custkey]", "[c_custkey]")], left_where="> ([o_totalprice], int[1000])")
    ls = R.hash_join(t("lineitem"), sn, TRUE, *keep(("l_orderkey", "int"), ("l_extendedprice", "double"), ("l_discount", "double"), ("s_nationkey", "int"), ("n_name", "string")), [("[l_suppkey]", "[s_suppkey]")])
    out = R.hash_join(ls, co, TRUE, ["[n_name]", "* ([l_extendedprice], - (int[1], [l_discount]))"], [("n_name", "string"), ("price", "double")], [("[l_orderkey]", "[o_orderkey]"), ("[s_nationkey]", "[c_nationkey]")])
    return R.aggregate(out, [("sum", "[price]")], ["[n_name]"], TRUE, [("n_name", "string"), ("revenue", "double")]).withColumn("revenue", F.round("revenue", 2))


# aggregation


@query("SELECT CAST(count(*) AS INT) AS mycnt FROM lineitem WHERE l_returnflag = 'R'")
def agg_global_count(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), [("cnt", "int[0]")], [], "== ([l_returnflag], string[R])", [("mycnt", "int")])


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS total, CAST(sum(l_linenumber) AS INT) AS lines FROM lineitem")
def agg_sum(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), [("sum", "* ([l_extendedprice], [l_discount])"), ("sum", "[l_linenumber]")], [], TRUE, [("total", "double"), ("lines", "int")]).withColumn("total", F.round("total", 2))


@query("SELECT round(avg(l_quantity), 6) AS q, round(avg(l_linenumber), 6) AS n FROM lineitem WHERE l_linenumber < 4")
def agg_avg(spark, sf_dir):
    out = R.aggregate(table(spark, sf_dir, "lineitem"), [("avg", "[l_quantity]"), ("avg", "[l_linenumber]")], [], "< ([l_linenumber], int[4])", [("q", "double"), ("n", "double")])
    return out.select(F.round("q", 6).alias("q"), F.round("n", 6).alias("n"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS q, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY l_returnflag")
def agg_group_1(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), [("avg", "[l_quantity]"), ("cnt", "int[0]")], ["[l_returnflag]"], TRUE, [("l_returnflag", "string"), ("q", "double"), ("n", "int")]).withColumn("q", F.round("q", 6))


@query("SELECT l_returnflag, l_linenumber, round(sum(l_extendedprice), 2) AS total, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber")
def agg_group_2(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), [("sum", "[l_extendedprice]"), ("cnt", "int[0]")], ["[l_returnflag]", "[l_linenumber]"], TRUE, [("l_returnflag", "string"), ("l_linenumber", "int"), ("total", "double"), ("n", "int")]).withColumn("total", F.round("total", 2))


@query("SELECT n_regionkey AS a, n_nationkey // 5 AS b, CAST(count(*) AS INT) AS n FROM nation GROUP BY 1, 2")
def agg_equal_keys(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "nation"), [("cnt", "int[0]")], ["[n_regionkey]", "/ ([n_nationkey], int[5])"], TRUE, [("a", "int"), ("b", "int"), ("n", "int")])


@query("SELECT CAST(o_custkey // 100 AS INT) AS bucket, round(avg(o_totalprice), 4) AS price, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1")
def agg_group_expr(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "orders"), [("avg", "[o_totalprice]"), ("cnt", "int[0]")], ["/ ([o_custkey], int[100])"], TRUE, [("bucket", "int"), ("price", "double"), ("n", "int")]).withColumn("price", F.round("price", 4))


@query("SELECT l_linestatus, CAST(count(*) AS INT) AS n FROM lineitem WHERE l_quantity > 10 AND NOT l_returnflag = 'N' GROUP BY l_linestatus")
def agg_filtered(spark, sf_dir):
    return R.aggregate(table(spark, sf_dir, "lineitem"), [("cnt", "int[0]")], ["[l_linestatus]"], "&& (> ([l_quantity], int[10]), ! (== ([l_returnflag], string[N])))", [("l_linestatus", "string"), ("n", "int")])


@query("SELECT CAST(sum(n) AS INT) AS total, CAST(count(*) AS INT) AS n_groups FROM (SELECT o_custkey // 10, count(*) AS n FROM orders GROUP BY 1)")
def agg_of_agg(spark, sf_dir):
    one = R.aggregate(table(spark, sf_dir, "orders"), [("cnt", "int[0]")], ["/ ([o_custkey], int[10])"], TRUE, [("bucket", "int"), ("n", "int")])
    return R.aggregate(one, [("sum", "[n]"), ("cnt", "int[0]")], [], TRUE, [("total", "int"), ("n_groups", "int")])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(count(*) AS INT) AS n FROM orders GROUP BY 1")
def agg_over_clustered(spark, sf_dir):
    return R.aggregate(clustered(table(spark, sf_dir, "orders"), "o_orderdate"), [("cnt", "int[0]")], ["[o_orderdate]"], TRUE, [("day", "string"), ("n", "int")])


# sort


@query("SELECT c_custkey, c_acctbal FROM customer")
def sort_full(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "customer"), "[c_acctbal]").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_acctbal FROM customer")
def sort_expr(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "customer"), "um ([c_acctbal])").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey > 20")
def sort_filtered(spark, sf_dir):
    return R.sort(table(spark, sf_dir, "customer"), "[c_name]", "> ([c_nationkey], int[20])").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def sort_in_partitions(spark, sf_dir):
    return R.sort_within(table(spark, sf_dir, "customer"), "[c_mktsegment]").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 3 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey > 22 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 10")
def merge_sorted(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    parts = [R.sort(c, "[c_acctbal]", w).select("c_custkey", "c_acctbal") for w in ("< ([c_nationkey], int[3])", "> ([c_nationkey], int[22])", "== ([c_nationkey], int[10])")]
    return R.merge(parts, "[c_acctbal]")


# scans, text, statistics


@query("SELECT n_name, n_regionkey FROM nation UNION ALL SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def union_page_list(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    return R.pages(n, R.point(n, "n_regionkey", 2))


NATION = [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]


def _nation_pages(spark, sf_dir):
    """A heap of five pages, one for each region."""
    stored = Stored(spark, Table("nation", NATION, scratch(spark, "heap"), HEAP))
    for region in (3, 0, 4, 1, 2):
        stored.append(table(spark, sf_dir, "nation").where(f"n_regionkey = {region}").coalesce(1))
    return stored


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 4, 1)")
def scan_page_range(spark, sf_dir):
    return _nation_pages(spark, sf_dir).page_range(1, 3).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def scan_single_page(spark, sf_dir):
    return _nation_pages(spark, sf_dir).page(4).select("n_nationkey", "n_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def text_roundtrip(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    folder = scratch(spark, "text")
    write_text(n, folder)
    return read_text(spark, folder, NATION)


@query("SELECT s_suppkey || '|' || s_name || '|' || s_nationkey || '|' || printf('%.6f', s_acctbal) || '|' AS value FROM supplier")
def text_lines(spark, sf_dir):
    return as_lines(table(spark, sf_dir, "supplier"))


SUPPLIER = [("s_suppkey", "int"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")]


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT CAST(s_suppkey AS INT), s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey > 4")
def stored_heap_append(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    stored = Stored(spark, Table("supplier", SUPPLIER, scratch(spark, "heap"), HEAP))
    stored.append(s.where("s_nationkey < 10"))
    stored.append(s.where("s_nationkey > 4"))
    return stored.read()


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000")
def stored_clustered_append(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    stored = Stored(spark, Table("supplier", SUPPLIER, scratch(spark, "tree"), CLUSTERED, "s_acctbal"))
    for part in range(3):
        stored.append(s.where(f"s_suppkey % 3 = {part}"))
    stored.recluster()
    return R.key_range(stored.read(), "s_acctbal", 0, 5000)


@query("SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 7")
def stored_clear(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    stored = Stored(spark, Table("supplier", SUPPLIER, scratch(spark, "heap"), HEAP))
    stored.append(s)
    stored.clear()
    stored.append(s.where("s_nationkey = 7"))
    return stored.read()


@query("SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('heap'), ('bplustree')) k(kind) UNION ALL SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('heap'), ('bplustree')) k(kind) WHERE n_regionkey = 1")
def stored_stream(spark, sf_dir):
    """Two streamed batches and an append, in a heap and in a clustered table."""
    n, out = table(spark, sf_dir, "nation"), []
    for kind, key in ((HEAP, None), (CLUSTERED, "n_name")):
        folder = scratch(spark, "stream")
        stored = Stored(spark, Table("nation", NATION, f"{folder}/table", kind, key))
        for part in range(2):
            write_text(n.where(f"n_regionkey % 2 = {part}"), f"{folder}/in", "append")
            ingest(stored, f"{folder}/in", f"{folder}/checkpoint").awaitTermination()
        stored.append(n.where("n_regionkey = 1"))
        out.append(stored.read().select(F.lit(kind).alias("kind"), *[name for name, _ in NATION]))
    return R.pages(*out)


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier")
def stored_layout(spark, sf_dir):
    stored = Stored(spark, Table("supplier", SUPPLIER, scratch(spark, "tree"), CLUSTERED, "s_acctbal"))
    stored.append(table(spark, sf_dir, "supplier"))
    return stored.layout().agg(F.sum("n_rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT n_regionkey AS x_n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS sum_x_n_nationkey FROM nation WHERE n_name <> 'x' GROUP BY 1")
def sql_create_load_select(spark, sf_dir):
    folder = scratch(spark, "engine")
    write_text(table(spark, sf_dir, "nation"), f"{folder}/nation.tbl")
    engine = Engine(spark, f"{folder}/db")
    engine.sql("CREATE TABLE nation (n_nationkey INT, n_name STRING, n_regionkey INT) AS BPLUSTREE ON n_name")
    engine.load("nation", f"{folder}/nation.tbl")
    return engine.sql('SELECT x.n_regionkey, SUM(x.n_nationkey) FROM nation AS x WHERE x.n_name <> "x" GROUP BY x.n_regionkey')


@query("SELECT * FROM (VALUES ('h', 'heap', NULL, 2), ('t', 'bplustree', 'k', 1)) v(name, file_type, sort_att, n_columns)")
def catalog_tables(spark, sf_dir):
    root = scratch(spark, "engine")
    engine = Engine(spark, root)
    engine.sql("CREATE TABLE h (a INT, b BOOL)")
    engine.sql("CREATE TABLE t (k STRING) AS BPLUSTREE ON k")
    found = Engine(spark, root).catalog.tables().values()
    return spark.createDataFrame([(t.name, t.file_type, t.sort_att, len(t.schema)) for t in found], "name string, file_type string, sort_att string, n_columns int")


DIMENSIONS = {
    "nation": "n_nationkey n_name n_regionkey", "region": "r_regionkey r_name", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows FROM {t}" for t, names in DIMENSIONS.items() for c in names.split()))
def stats_distinct_counts(spark, sf_dir):
    return R.pages(*[R.statistics(table(spark, sf_dir, t), exact=True).select(F.lit(t).alias("table_name"), "column_name", "n_distinct", "n_rows") for t in DIMENSIONS])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, true AS near FROM orders" for c in "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split()))
def stats_approximate(spark, sf_dir):
    """Whether each estimate is within a tenth of the exact count."""
    orders = table(spark, sf_dir, "orders")
    exact = R.statistics(orders, exact=True).select("column_name", F.col("n_distinct").alias("exact"))
    return R.statistics(orders).join(exact, "column_name").select("column_name", "n_rows", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


# SQL

NAMES = "customer orders lineitem supplier nation region part".split()


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return translated(parse_sql(text), {n: table(spark, sf_dir, n) for n in NAMES if f" {n} " in " ".join(text.split()) + " "})


@query("""SELECT r_name AS r_r_name, n_name AS n_n_name, round(sum(l_quantity), 2) AS sum_l_l_quantity, round(avg(l_extendedprice * l_discount), 4) AS value_4
FROM region, nation, supplier, lineitem, orders, customer WHERE r_regionkey = n_regionkey AND n_nationkey = s_nationkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey
AND o_custkey = c_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND strftime(o_orderdate, '%Y-%m-%d') >= '1997-07-01' AND strftime(o_orderdate, '%Y-%m-%d') < '1998-07-01' GROUP BY r_name, n_name""")
def sql_six_tables(spark, sf_dir):
    return sql(spark, sf_dir, """SELECT r.r_name, n.n_name, SUM(l.l_quantity), AVG(l.l_extendedprice * l.l_discount)
        FROM region AS r, nation AS n, supplier AS s, lineitem AS l, orders AS o, customer AS c
        WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = l.l_suppkey AND l.l_orderkey = o.o_orderkey
        AND o.o_custkey = c.c_custkey AND (c.c_mktsegment = "BUILDING" OR c.c_mktsegment = "MACHINERY")
        AND NOT o.o_orderdate < "1997-07-01" AND o.o_orderdate < "1998-07-01" GROUP BY r.r_name, n.n_name""").withColumn("sum_l_l_quantity", F.round("sum_l_l_quantity", 2)).withColumn("value_4", F.round("value_4", 4))  # fmt: skip


@query("SELECT p_brand || '/' || p_type AS value_1, p_size AS p_p_size FROM part WHERE p_brand > 'Brand#3' AND NOT p_size > 10")
def sql_text_values(spark, sf_dir):
    return sql(spark, sf_dir, 'SELECT p.p_brand + "/" + p.p_type, p.p_size FROM part AS p WHERE p.p_brand > "Brand#3" AND NOT p.p_size > 10')


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '2000-12-24' AND o_orderstatus <> 'F'")
def sql_days(spark, sf_dir):
    return sql(spark, sf_dir, 'SELECT o.o_orderkey, o.o_orderdate FROM orders AS o WHERE o.o_orderdate > "2000-12-24" AND o.o_orderstatus <> "F"')


@query("SELECT round(sum(l_quantity * 2 - l_tax / 4.0), 3) AS value_1, CAST(sum(l_linenumber * 10 // 3) AS BIGINT) AS value_2 FROM lineitem WHERE (l_quantity + 0.5) * 2 > 31 AND l_linenumber < 6")
def sql_arithmetic(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT SUM(l.l_quantity * 2 - l.l_tax / 4.0), SUM((l.l_linenumber * 10) / 3) FROM lineitem AS l WHERE (l.l_quantity + 0.5) * 2 > 31 AND (l.l_linenumber < 6)").withColumn("value_1", F.round("value_1", 3))


@query("SELECT c_name AS c_c_name, n_name AS n_n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND (c_acctbal > 9900 OR n_name = 'NATION_7') AND c_mktsegment <> 'BUILDING'")
def sql_disjunction_over_two_tables(spark, sf_dir):
    return sql(spark, sf_dir, 'SELECT c.c_name, n.n_name FROM customer AS c, nation AS n WHERE ("con" + "stant" = "constant") AND c.c_nationkey = n.n_nationkey AND (c.c_acctbal > 9900 OR n.n_name = "NATION_7") AND (2 > 3 OR c.c_mktsegment <> "BUILDING")')


@query("SELECT round(sum(0.25::DOUBLE * 4), 2) AS value_1, round(avg(c_acctbal), 6) AS avg_c_c_acctbal FROM customer")
def sql_constant_sum(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT SUM(0.25 * 4), AVG(c.c_acctbal) FROM customer AS c").select(F.round("value_1", 2).alias("value_1"), F.round("avg_c_c_acctbal", 6).alias("avg_c_c_acctbal"))


@query("SELECT a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def sql_self_join(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT a.n_name, b.n_name FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query("SELECT s_name AS s_s_name, r_name AS r_r_name FROM supplier, region WHERE s_acctbal > r_regionkey * 2000 AND s_nationkey < 3")
def sql_theta_join(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT s.s_name, r.r_name FROM supplier AS s, region AS r WHERE s.s_acctbal > r.r_regionkey * 2000 AND s.s_nationkey < 3")


@query("SELECT s_suppkey - (10 - (3 - 2)) AS value_1, 10 - (3 - 2) AS value_2, 100 // (10 // 5) AS value_3 FROM supplier WHERE s_nationkey <> 3")
def sql_right_associative(spark, sf_dir):
    return sql(spark, sf_dir, "select s.s_suppkey - 10 - 3 - 2, 10 - 3 - 2, 100 / 10 / 5 from supplier as s where s.s_nationkey <> 3")


@query("SELECT n_regionkey AS n_n_regionkey, avg(n_nationkey) AS avg_n_n_nationkey, CAST(sum(n_nationkey) AS BIGINT) AS sum_n_n_nationkey FROM nation WHERE n_nationkey > 2 GROUP BY n_regionkey")
def sql_group_by(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT n.n_regionkey, AVG(n.n_nationkey), SUM(n.n_nationkey) FROM nation AS n WHERE n.n_nationkey > 2 GROUP BY n.n_regionkey")


#: Statements over the tables of the test data, by the checker's rule that each keeps or breaks.
STATEMENTS = [
    ("known table", True, "SELECT p.p_name FROM part AS p"),
    ("known table", False, "SELECT p.p_name FROM parts AS p"),
    ("alias in FROM", True, "SELECT x.s_name FROM supplier AS x WHERE x.s_suppkey > 3"),
    ("alias in FROM", False, "SELECT y.s_name FROM supplier AS x"),
    ("column of the table", False, "SELECT x.c_name FROM supplier AS x, customer AS c"),
    ("column of the table", False, "SELECT o.o_orderkey FROM orders AS o WHERE o.o_day > 5"),
    ("numbers are one type", True, "SELECT o.o_orderkey FROM orders AS o WHERE o.o_totalprice > o.o_custkey"),
    ("numbers are one type", False, 'SELECT o.o_orderkey FROM orders AS o WHERE o.o_totalprice = "100"'),
    ("arithmetic of numbers", True, "SELECT p.p_size * 3 - p.p_retailprice / 2 FROM part AS p"),
    ("arithmetic of numbers", False, "SELECT p.p_size * p.p_brand FROM part AS p"),
    ("arithmetic of numbers", False, 'SELECT c.c_custkey FROM customer AS c WHERE c.c_acctbal - "1" > 0'),
    ("sum of equal types", True, 'SELECT n.n_name + "-" + n.n_name, n.n_nationkey + 0.5 FROM nation AS n'),
    ("sum of equal types", False, "SELECT n.n_name + n.n_nationkey FROM nation AS n"),
    ("comparison of equal types", True, 'SELECT l.l_orderkey FROM lineitem AS l WHERE l.l_shipdate > "1999-01-01" AND l.l_returnflag <> l.l_linestatus'),
    ("comparison of equal types", False, "SELECT l.l_orderkey FROM lineitem AS l WHERE l.l_shipdate < l.l_quantity"),
    ("OR and NOT of conditions", True, "SELECT r.r_name FROM region AS r WHERE (r.r_regionkey > 1 OR NOT r.r_regionkey = 0)"),
    ("OR and NOT of conditions", False, 'SELECT r.r_name FROM region AS r WHERE (r.r_regionkey > 1 OR NOT r.r_name > 2)'),
    ("totals of numbers", True, "SELECT SUM(l.l_tax * 100), AVG(l.l_linenumber) FROM lineitem AS l"),
    ("totals of numbers", False, "SELECT AVG(s.s_name) FROM supplier AS s"),
    ("totals of numbers", False, 'SELECT SUM(l.l_returnflag + "x") FROM lineitem AS l'),
    ("values of groups", True, "SELECT c.c_mktsegment, c.c_nationkey + 1, SUM(c.c_acctbal) FROM customer AS c WHERE c.c_custkey > 0 GROUP BY c.c_mktsegment, c.c_nationkey + 1"),
    ("values of groups", False, "SELECT c.c_mktsegment, c.c_name, AVG(c.c_acctbal) FROM customer AS c WHERE c.c_custkey > 0 GROUP BY c.c_mktsegment"),
    ("every condition", False, "SELECT r.r_name FROM region AS r WHERE r.r_regionkey = 1 AND r.r_name = r.r_name AND r.r_name > 7"),
    ("every condition", False, 'SELECT r.r_name FROM region AS r WHERE (r.r_regionkey = 1 OR r.r_name = "ASIA" OR r.r_regionkey = "ASIA")'),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{rule}', {str(ok).lower()})" for i, (rule, ok, _) in enumerate(STATEMENTS, 1)) + ") t(id, rule, valid)")
def sql_checker_verdicts(spark, sf_dir):
    tables = {n: schema_of(table(spark, sf_dir, n)) for n in NAMES}
    found = [(i, rule, not check(parse_sql(text), tables)) for i, (rule, _, text) in enumerate(STATEMENTS, 1)]
    return spark.createDataFrame(found, "id int, rule string, valid boolean")


@query("""SELECT * FROM (VALUES (1, 'nation: 3 columns'), (2, 'nation: 25 rows loaded'), (3, 'n_n_regionkey|sum_n_n_nationkey'), (4, 'Error: no table has the alias of n.n_name'), (5, 'Catalog saved.')) t(line, text)
UNION ALL SELECT 10 + n_regionkey, n_regionkey || '|' || sum(n_nationkey) || '|' FROM nation WHERE n_name <> '' GROUP BY n_regionkey""")
def prompt_session(spark, sf_dir):
    """What the prompt prints for statements over several lines, a load, an error and the end."""
    folder = scratch(spark, "engine")
    write_text(table(spark, sf_dir, "nation"), f"{folder}/nation.tbl")
    out = io.StringIO()
    text = f"""CREATE TABLE nation
        (n_nationkey INT, n_name STRING, n_regionkey LONG); load nation from {folder}/nation.tbl;
        load nation from {folder}/nation.tbl;
        SELECT n.n_regionkey, SUM(n.n_nationkey) FROM nation AS n
        WHERE n.n_name <> "" GROUP BY n.n_regionkey;
        SELECT n.n_name FROM nation AS m;
        exit; SELECT"""
    prompt(Engine(spark, f"{folder}/db"), text.splitlines(), out)
    lines = out.getvalue().splitlines()
    told = [x for x in lines if "|" not in x or x[0] not in "0123456789"]
    groups = [x for x in lines if x not in told]
    return spark.createDataFrame([*enumerate(told, 1), *((10 + int(x.split("|")[0]), x) for x in groups)], "line int, text string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tables joined, filtered and grouped, through the SQL dialect."""
    return sql_six_tables(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "Engine", "flagship"]

import io

import pytest

from tessera.engine import Engine, prompt
from tessera.plans.checker import CheckError, check
from tessera.plans.lexer import SqlError, tokens
from tessera.plans.parser import Create, parse_sql
from tessera.functions.types import EngineError, schema_of
from tessera.queries import NAMES, STATEMENTS, table
from tessera.sources.versions import Conflict, Log
from tessera.streaming.ingest import ingest

T = {"t": {"a": "int", "b": "double", "s": "string", "x-1": "int", "f": "bool"}, "u": {"a": "int"}}


def where(text):
    return [str(e) for e in parse_sql(f"SELECT t.a FROM t AS t WHERE {text}").where]


def test_verdicts(spark, sf_dir):
    tables = {n: schema_of(table(spark, sf_dir, n)) for n in NAMES}
    assert [not check(parse_sql(text), tables) for _, _, text in STATEMENTS] == [ok for _, ok, _ in STATEMENTS]
    # what is wrong is wrong for one reason only, but that no column is known of a table that isn't
    assert all(len(check(parse_sql(text), tables)) == 1 + (rule == "known table") for rule, ok, text in STATEMENTS if not ok)


def test_lexer():
    assert [t.kind for t in tokens('select a-b.x_1 12 1.5 -2 1e5 "a\\"b" <>')] == ["SELECT", "IDENTIFIER", ".", "IDENTIFIER", "INTEGER", "DBL", "DBL", "DBL", "STR", "<", ">", "END"]
    with pytest.raises(SqlError, match="line 2"):
        tokens("select\n'x'")
    with pytest.raises(SqlError):
        tokens("a\r")


def test_right_associative():
    values = [str(e) for e in parse_sql("select 10 - 3 - 2, 8 / 4 / 2, 1 + 2 * 3 - 4 from t as t").values]
    assert values == ["- (int[10], - (int[3], int[2]))", "/ (int[8], / (int[4], int[2]))", "+ (int[1], - (* (int[2], int[3]), int[4]))"]


def test_conditions():
    assert where("(t.a > 1 OR t.b < 2.5) AND NOT t.a <> 3") == ["|| (> ([t.a], int[1]), < ([t.b], double[2.500000]))", "! (!= ([t.a], int[3]))"]
    assert where("(t.a + 1) > 3") == ["> (+ ([t.a], int[1]), int[3])"]
    assert where("(t.a) = t.a AND (NOT t.a = 1)") == ["== ([t.a], [t.a])", "! (== ([t.a], int[1]))"]


@pytest.mark.parametrize("text", ["SELECT t.a FROM t", "SELECT t.a FROM t AS t GROUP BY t.a", "SELECT SUM(t.a) + 1 FROM t AS t", "SELECT 1 -2 FROM t AS t", "SELECT a FROM t AS t", "SELECT t.a FROM t AS t WHERE (t.a > 1) OR (t.a < 0)", "DROP t", "SELECT t.a FROM t AS t WHERE NOT (t.a = 1)", ""])
def test_syntax_errors(text):
    with pytest.raises(SqlError):
        parse_sql(text)


def test_details():
    assert str(parse_sql("SELECT 1 + SUM(t.a) FROM t AS t").values[0]) == "+ (int[1], sum([t.a]))"
    assert parse_sql("SELECT t.x-1 FROM t AS t").values[0].value == "t.x-1"
    assert parse_sql('SELECT "a\\"b" FROM t AS t').values[0].value == 'a\\"b'
    assert parse_sql("SELECT 0.0000001 FROM t AS t").values[0].value == 0.0
    assert parse_sql("create table w (a int, s String) as bplustree on a") == Create("w", [("a", "int"), ("s", "string")], "a")


@pytest.mark.parametrize(
    "text, wrong",
    [
        ("SELECT t.a FROM v AS t", "no table v"), ("SELECT w.a FROM t AS t", "alias"), ("SELECT t.z FROM t AS t", "no column"), ("SELECT t.s - 1 FROM t AS t", "- doesn't take"),
        ("SELECT t.s + 1 FROM t AS t", "+ doesn't take"), ("SELECT t.f + t.f FROM t AS t", "+ doesn't take"), ("SELECT t.a FROM t AS t WHERE t.a > t.s", "> doesn't take"), ("SELECT SUM(t.s) FROM t AS t", "sum doesn't take"),
        ("SELECT t.a, SUM(t.b) FROM t AS t WHERE t.a > 0 GROUP BY t.b", "neither"), ("SELECT t.a, SUM(t.b) FROM t AS t", "beside"), ("SELECT t.a FROM t AS t WHERE SUM(t.a) > 1", "outside"), ("SELECT SUM(SUM(t.a)) FROM t AS t", "within"),
        ("SELECT t.a FROM t AS t, u AS t", "twice"),
    ],
)
def test_checks(text, wrong):
    assert any(wrong in e for e in check(parse_sql(text), T))


@pytest.mark.parametrize("text", ["SELECT t.s + t.s FROM t AS t", "SELECT t.a + t.b * 2 FROM t AS t", "SELECT t.a + 1, AVG(t.b) FROM t AS t WHERE t.a > 0 GROUP BY t.a + 1", "SELECT t.f FROM t AS t WHERE t.f = t.f OR t.a < t.b"])
def test_right_statements(text):
    assert check(parse_sql(text), T) == []


def test_engine_from_text_to_rows(spark, tmp_path):
    (tmp_path / "s.tbl").write_text("1|Ann|10.5|true|\n2|Bob|4192.4|false|\n3||-0.25|true\n12x|Eve|7|false|\n")
    out = io.StringIO()
    script = f"""CREATE TABLE p (k INT, n STRING, v DOUBLE, f BOOL) AS BPLUSTREE ON k;
    load p from {tmp_path}/s.tbl;
    SELECT x.k, x.n + "!", x.v FROM p AS x WHERE x.k < 3;
    SELECT x.z FROM p AS x; the rest of a line is dropped
    SELECT SUM(x.v) FROM
      p AS x;
    select;
    load q from nowhere;
    exit;
    SELECT"""
    engine = Engine(spark, str(tmp_path / "db"))
    prompt(engine, script.splitlines(), out)
    text = out.getvalue()
    assert "p: 4 columns" in text and "p: 4 rows loaded" in text and "1|Ann!|10.500000|" in text and "2|Bob!|4192.400000|" in text
    assert "has no column z" in text and "4209.650000|" in text and "syntax error" in text and "no table q" in text and text.endswith("Catalog saved.\n")
    again = Engine(spark, str(tmp_path / "db"))
    table = again.catalog.table("p")
    assert (table.tuple_count, table.distinct["k"], table.sort_att, table.file_type) == (4, 4, "k", "bplustree")
    assert sorted(r.x_k for r in again.sql("SELECT x.k FROM p AS x").collect()) == [1, 2, 3, 12]
    with pytest.raises(EngineError):
        again.sql("CREATE TABLE p (k INT)")
    with pytest.raises(EngineError):
        again.sql("CREATE TABLE r (k INT) AS BPLUSTREE ON z")
    with pytest.raises(CheckError):
        again.sql("SELECT x.k + x.n FROM p AS x")


def test_stored_tables(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    for kind in ("heap", "tree"):
        engine.sql(f"CREATE TABLE {kind} (k INT, s STRING)" + (" AS BPLUSTREE ON k" if kind == "tree" else ""))
        stored = engine.stored(kind)
        assert stored.read().count() == 0 and stored.files() == []
        for part in range(3):
            stored.append(spark.createDataFrame([(k, f"r{k}") for k in range(part, 90, 3)], "k int, s string").coalesce(1))
        assert stored.read().count() == 90
        if kind == "tree":
            before = stored.read()
            stored.recluster()
            assert len(stored.runs()) == 1 and before.count() == 90  # those who read the old runs still can
            assert [r.k for r in stored.read().where("k between 10 and 19").orderBy("k").collect()] == list(range(10, 20))
            assert stored.vacuum() == 0 and stored.vacuum(hours=0) > 0 and stored.read().count() == 90
        else:
            assert [sorted(r.k for r in stored.page(k).collect()) for k in range(3)] == [list(range(k, 90, 3)) for k in range(3)]
            assert stored.page_range(1, 9).count() == 60 and stored.page_range(3, 9).count() == 0 and stored.page_range(-5, 0).count() == 30
            stored.overwrite(stored.read().where("k < 10"))  # of its own rows
            assert sorted(r.k for r in stored.read().collect()) == list(range(10))
        stored.clear()
        assert stored.read().count() == 0
    assert engine.load("heap", f"{tmp_path}/missing.tbl").tuple_count == 0


def test_versions(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/v")
    states = [log.state()]
    for k in range(50):
        states.append(log.commit(states[-1], {f"e{k}": [k]}, [f"e{k - 5}"] if k % 7 == 0 else [], {"last": k}))
    for state in states:  # each is read as it was written
        assert log.state(state.version)[:3] == state[:3]
    with pytest.raises(Conflict):
        log.commit(states[10], {"x": []}, [])
    assert log.state() == states[-1] and states[-1].listed > 0
    log.forget(keep=2)
    assert len(log.versions()) < 50 and log.state()[:3] == states[-1][:3] and log.state(49)[:3] == states[49][:3]


def test_names_that_look_alike(spark):
    from tessera.plans.translate import translated

    one, other = spark.createDataFrame([(1,)], "b_c int"), spark.createDataFrame([(2,)], "c int")
    got = translated(parse_sql("SELECT a.b_c, a_b.c FROM t AS a, u AS a_b WHERE a.b_c < a_b.c"), {"t": one, "u": other})
    assert [tuple(r) for r in got.collect()] == [(1, 2)]


def test_wide_ints(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.sql("CREATE TABLE t (long INT, k LONG)")
    (tmp_path / "t.tbl").write_text("1|4294967296|\n2|8589934592|\n")
    assert engine.load("t", f"{tmp_path}/t.tbl").tuple_count == 2
    assert [tuple(r) for r in engine.sql("SELECT SUM(x.k), SUM(x.long) FROM t AS x").collect()] == [(3 << 32, 3)]


def test_bad_text(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.sql("CREATE TABLE t (k INT, f BOOL)")
    for text in ("1|yes|\n", "x|true|\n", "1|\n"):
        (tmp_path / "bad.tbl").write_text(text)
        with pytest.raises(Exception, match="not a|fewer than"):
            engine.load("t", f"{tmp_path}/bad.tbl")


@pytest.mark.parametrize("kind", ["", " AS BPLUSTREE ON k"])
def test_stream_of_text(spark, tmp_path, kind):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.sql(f"CREATE TABLE t (k INT, v DOUBLE){kind}")
    stored, folder = engine.stored("t"), tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        (folder / f"{part}.tbl").write_text("".join(f"{k}|{k / 2}|\n" for k in range(part * 10, part * 10 + 10)))
        ingest(stored, str(folder), str(tmp_path / "ck")).awaitTermination(60)
        found = engine.sql("SELECT x.k, x.v FROM t AS x").collect()
        assert sorted((r.x_k, r.x_v) for r in found) == [(k, k / 2) for k in range(part * 10 + 10)]
    stored.append(spark.createDataFrame([(99, 1.5)], "k int, v double"))
    assert stored.read().count() == 31
    (stream, last), = stored.log.state().meta["streams"].items()
    assert last == 2
    if kind:
        stored.recluster()
        for f in stored.files():
            own = [r.k for r in spark.read.parquet(f).collect()]
            assert own == sorted(own)
    # a batch that comes again is known, also after its run was merged
    stored.append(spark.createDataFrame([(5, 2.5)], "k int, v double"), (stream, 2))
    assert stored.read().count() == 31
    (folder / "bad.tbl").write_text("7\n")
    with pytest.raises(Exception, match="fewer than"):
        query = ingest(stored, str(folder), str(tmp_path / "ck"))
        query.awaitTermination(60)
    assert stored.read().count() == 31

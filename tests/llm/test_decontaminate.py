import random

from pyspark.sql import functions as F

from tessera.llm.decontaminate import automaton, brute_force, decontaminated, patterns, scan


def rows(spark, docs, bench, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    out = decontaminated(d, b, **more)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return [r.asDict() for r in out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated").collect()]


def key(r):
    return repr(r)


def cases(seed, n=60):
    r = random.Random(seed)
    words = ["a", "b", "C", "é", "1", "x2", "中"]
    text = lambda k: r.choice([" ", ", ", "\n"]).join(r.choice(words[: r.randint(2, 7)]) for _ in range(k))
    bench = [(i, text(r.choice([0, 1, 3, 12, 13, 14, 20]))) for i in range(12)]
    docs = [(i, text(r.randint(0, 60)) + (" " + r.choice(bench)[1] if r.random() < 0.5 else "")) for i in range(n)]
    return docs + [(1, None), (1, ""), (None, "a b"), (n, "word " * 50_000)], bench + [(3, None), (None, "a b"), (4, "..."), bench[1]]


def test_against_brute_force(spark):
    for seed in range(3):
        docs, bench = cases(seed)
        want = sorted(brute_force(docs, bench), key=key)
        assert sorted(rows(spark, docs, bench), key=key) == want
        assert sorted(rows(spark, docs, bench, block_chars=60), key=key) == want  # several automata


def test_empty_tables(spark):
    docs, bench = cases(9)
    none = rows(spark, docs, [])
    assert len(none) == len(docs) and not any(r["n_hit"] or r["contaminated"] for r in none)
    assert rows(spark, [], bench) == []


def test_spans_are_of_the_original(spark):
    item = " ".join(f"w{i}" for i in range(15))
    text = "É — Hello, " + item.upper().replace(" ", " ... ") + "! the end"
    found = scan(automaton(patterns([("7", item)])), text.encode())
    ((span,),) = [found["spans"]]
    assert text[span["start"] : span["end"]].startswith("W0 ...") and text[span["start"] : span["end"]].endswith("W14")
    assert found["items"] == ["7"] and found["ranges"] == [3, 17] and found["n_words"] == 20  # the dash is no ASCII: a word


def test_rule_and_clashing_columns(spark):
    bench = [(1, " ".join(f"q{i}" for i in range(13)))]
    clean = " ".join(f"c{i}" for i in range(13 * 19))
    docs = [(1, f"{clean} {bench[0][1]}"), (2, f"{clean} x {bench[0][1]}")]
    got = {r["doc_id"]: r["contaminated"] for r in rows(spark, docs, bench)}
    assert got == {1: True, 2: False}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("mine")).withColumn("items", F.lit(0))
    out = decontaminated(d, spark.createDataFrame(bench, "item_id long, text string"), prefix="_s_")
    assert {(r.doc_id, r.n_hit, r._s_contaminated) for r in out.collect()} == {(1, "mine", True), (2, "mine", False)}

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.pieces import LONG, MARK, _units, decoded, encoded, encoded_units, loaded, plain, units_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_units_and_heap_agree_with_the_library(library):
    model, r = loaded(PATH), random.Random(3)
    for _ in range(1500):
        text = "".join(r.choice("abethinorTH  .,%\n\té²ü中\U0001F600" + MARK) for _ in range(r.randint(0, 60)))
        own = [i for u in units_of(text) for i in model.merge(u)]
        assert own == library.encode(text)
        assert model.decode(np.array(own, int)) == text.replace(MARK, " ")
        if plain(pa.array([text]))[0].as_py():
            assert [u for w in text.split(" ") for u in units_of(w)] == units_of(text)


def test_encoding_of_defined_cases(spark, tmp_path, library):
    texts = ["", None, "x  y\n", "日本 語²!!a", "a" * 300 + " " + "=" * 200 + " " + "ab" * 50, "the the the", " lead", "trail ", "one▁two", "word " * 30_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "the", "x"), (2, "x  y\n", "again")], "doc_id long, text string, ids string")
    df.write.parquet(str(tmp_path / "d"))
    for docs in (df, spark.read.parquet(str(tmp_path / "d")), df.distinct()):
        got = decoded(encoded(docs, PATH, checks=True).withColumn("own", F.col("pieces.ids")), PATH, "own").collect()
        assert len(got) == docs.count()
        for r in got:
            want = None if r.text is None else library.encode(r.text)
            assert r.own == want
            if want is not None:
                assert r.pieces.n_pieces == len(want) and r.pieces.crc32 == zlib.crc32(np.array(want, "<i4").tobytes())
                assert r.pieces.round_trip and r.decoded == r.text.replace(MARK, " ")
    assert encoded(df.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, library):
    from tessera.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op1_pieces"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), True)


def test_the_best_path_is_the_librarys(spark, library):
    """The fold against the heap, which the test above holds to the library, on units of all kinds and lengths."""
    model, r = loaded(PATH), random.Random(5)
    units = {"".join(r.choice(letters) for _ in range(r.randint(1, most))) for letters, most, n in (("abethinorst", 14, 1500), ("aab=-", 40, 300), ("ab", LONG, 20), ("é²ü中x" + MARK, 9, 200)) for _ in range(n)}
    units |= {"a" * LONG, "=" * LONG, *r.sample(sorted(model.table), 1500), *(MARK * n + w for n in range(1, 40) for w in ("", "the", "é", "中"))}
    got = encoded_units(spark.createDataFrame([(u,) for u in sorted(units)], "unit string"), model).collect()
    assert len(got) == len(units) and all(x.ids == model.merge(x.unit) for x in got)


def test_one_path_only_costs_nothing():
    """To each position of a unit, of all edges that end there exactly one stays apart from the best path before it."""
    model, r = loaded(PATH), random.Random(2)
    for _ in range(300):
        unit = "".join(r.choice("abethinorst") for _ in range(r.randint(2, 12)))
        own = [(a, b) for a in range(len(unit)) for b in range(a + 1, len(unit) + 1) if b == a + 1 or unit[a:b] in model.table]
        best = {}
        for k in range(1, len(unit) + 1):
            apart = [(a, b) for a, b in own if b == k and (a == 0 or len(model.merge(unit[best[a][0] : k])) == len(model.merge(unit[best[a][0] : a])) + 1 and model.merge(unit[best[a][0] : k])[1:] == model.merge(unit[a:k]))]
            assert len(apart) == 1
            best[k] = apart[0]


def test_sums_of_scores_are_another_model(library):
    """Why paths aren't scored by their pieces' scores: that gives other ids for most words."""
    model = loaded(PATH)

    def scored(unit):
        best = [(0, 0)]
        for k in range(1, len(unit) + 1):
            best.append(min((best[a][0] + model.ranks.get(unit[a:k], 10**9), a) for a in range(max(0, k - model.longest), k) if k - a == 1 or unit[a:k] in model.table))
        out, k = [], len(unit)
        while k:
            out.append(unit[best[k][1] : k])
            k = best[k][1]
        return out[::-1]

    words = [MARK + w for w in "encoding decoding lattice analytics distributed partition executor shuffles aggregate language fingerprint".split()]
    differ = sum(scored(w) != [model.pieces[i][0] for i in model.merge(w)] for w in words)
    assert differ > len(words) // 4


def test_other_splits_are_an_error(spark, tmp_path):
    spark.createDataFrame([(i, f"some text number {i} " * 200) for i in range(2000)], "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "d"))
    out = encoded(spark.read.parquet(str(tmp_path / "d")), PATH, ids=False)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        with pytest.raises(Exception, match="other splits"):
            spark.createDataFrame(encoded_again(out).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def encoded_again(df):
    """The same plan, planned anew."""
    return df.select("*")


def test_texts_are_cut_once(spark, sf_dir):
    """The lattice and what it's joined to read the same exchange."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = encoded_units(_units(docs, F.lit(1).cast("bigint")), loaded(PATH))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("ReusedExchange") == 1 and plan.count("MapInArrow") == 3  # one that ran, two of the plan before


def test_a_clash_is_an_error(spark):
    df = spark.createDataFrame([("x", 1)], "text string, Pieces int")
    with pytest.raises(ValueError, match="pieces"):
        encoded(df, PATH)
    with pytest.raises(ValueError, match="text"):
        decoded(df, PATH, "Pieces", "text")
    assert encoded(df, PATH, "other").columns == ["text", "Pieces", "other"]


def test_words_are_cut_as_texts_are():
    """Before, units_of_words wasn't there: every word went through the cutter in Python, twice for each split."""
    from tessera.llm import pieces

    words = ["one", "two,", "x_1", "!?", "Ünder.", "ét", "×÷", "日本語", "a1b2", "it's", "ª", "ß!", "12", "\\]^[`{~", "ab\n", "\t", "ÿ-ÿ", "x" * 200 + "."]
    units, place, sizes = pieces.units_of_words(pa.array(words, pa.string()))
    starts = np.cumsum(sizes) - sizes
    assert [units[int(starts[k]) : int(starts[k] + sizes[k])].to_pylist() for k in place] == [units_of(w) for w in words]
    units, place, sizes = pieces.units_of_words(pa.array([], pa.string()))
    assert len(units) == len(place) == len(sizes) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_characters=" ▁", exclude_categories=["Cs"]), min_size=1, max_size=12), max_size=8))
def test_any_words_are_cut_as_texts_are(words):
    from tessera.llm.pieces import units_of_words

    units, place, sizes = units_of_words(pa.array(words, pa.string()))
    starts = np.cumsum(sizes) - sizes
    assert [units[int(starts[k]) : int(starts[k] + sizes[k])].to_pylist() for k in place] == [units_of(w) for w in words]


def test_units_are_looked_up_once(monkeypatch):
    from tessera.llm import pieces

    model, texts = loaded(PATH), ["one two, x_1 two", "", "  Ünder 日本 one!"]
    own = pieces.Lookup.__new__(pieces.Lookup)
    own.model, own.long, own.units = model, LONG, pa.array(sorted({u for t in texts for u in units_of(t)}))
    ids = [model.merge(u) for u in own.units.to_pylist()]
    own.ids, own.sizes = np.array([i for x in ids for i in x], "<i4"), np.array([len(x) for x in ids], np.int64)
    own.starts, found, real = np.cumsum(own.sizes) - own.sizes, [], pieces.pc.index_in
    monkeypatch.setattr(pieces.pc, "index_in", lambda *a, **k: found.append(1) or real(*a, **k))
    got, sizes = own.encode(pa.array(texts[:1], pa.string()))
    assert got.tolist() == [i for u in units_of(texts[0]) for i in model.merge(u)] and sizes.tolist() == [len(got)] and len(found) == 1
    got, sizes = own.encode(pa.array(texts, pa.string()))
    assert got.tolist() == [i for t in texts for u in units_of(t) for i in model.merge(u)]

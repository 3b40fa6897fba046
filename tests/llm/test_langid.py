import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.langid import Model, family, features, held_out, identified, learned


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark):
    from tessera.llm.queries import QUERIES

    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op7_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r for r in got if r.held_out]
    assert len(own) > 150 and sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.98 * len(own)


def test_defined_cases(spark, docs):
    model = learned(docs, ~held_out())
    rows = [(1, None), (2, ""), (3, "123 %% !!"), (3, "the words of this and that"), (None, "der die und das mit nicht"), (4, "the " * 200_000), (4, "É")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.withColumn("LANG_PRED", F.lit("clash")).withColumn("__lang", F.lit(0))
    with pytest.raises(ValueError, match="lang_pred"):
        identified(clash, model)
    out = identified(clash, model, "my_")
    assert out.columns == ["doc_id", "text", "LANG_PRED", "__lang", "my_lang_pred", "my_score"]
    assert {(r.LANG_PRED, r["__lang"]) for r in out.collect()} == {("clash", 0)}
    got = [(r.lang_pred, r.score) for r in identified(df, model).orderBy(F.monotonically_increasing_id()).collect()]
    assert [g[0] for g in got[:6]] == ["und", "und", "und", "en", "de", "en"] and got[0][1] == got[2][1] == 0 and got[6][0] != "und"
    assert identified(df.limit(0), model).count() == 0


def test_labels_and_ids_are_no_inputs(docs):
    one = learned(docs, ~held_out())
    other = learned(docs.withColumn("source", F.lit("x")), ~held_out())
    assert (one.weights == other.weights).all()
    changed = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert learned(changed, ~held_out()).langs == one.langs


def test_a_repeated_row_counts_once(spark, docs):
    rows = docs.where("lang = 'fr'").limit(5)
    often = rows.select("doc_id", "text", F.lit("de").alias("lang"), F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("k")).drop("k")
    one, many = learned(docs.select("doc_id", "text", "lang"), ~held_out(), 10**6), learned(docs.select("doc_id", "text", "lang").union(docs.select("doc_id", "text", "lang")), ~held_out(), 10**6)
    assert (one.weights == many.weights).all()
    assert learned(often, F.lit(True)).langs == ["de"]
    with pytest.raises(ValueError, match="lang"):
        learned(docs.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True), languages=50)


def test_few_labels(spark, docs):
    none = learned(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none.predict("some words") == ("und", 0.0)
    single = learned(docs.where("lang = 'fr'"), F.lit(True))
    assert single.predict("le la les") == ("fr", 1.0)
    # the texts are of invented words: only texts of the table are sure to be of a language
    text = {lang: max((r.text for r in docs.where(F.col("lang") == lang).where(held_out()).collect()), key=len) for lang in ("fr", "es", "de")}
    kin = learned(docs.where("lang in ('fr', 'es')"), F.lit(True))
    assert kin.families == ["romance"] and [kin.predict(text[x])[0] for x in ("fr", "es")] == ["fr", "es"]
    odd = learned(docs.withColumn("lang", F.when(F.col("lang") == "de", F.lit("qq")).otherwise(F.col("lang"))), F.lit(True))
    assert odd.families == ["germanic", "qq", "romance"] and odd.predict(text["de"])[0] == "qq"


def test_features():
    assert features(None) is features("1 2") is None
    a, b = features("The END, the end!"), features("the end the end")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
    assert family("en-GB") == family("de") != family("fr") and family("zz") == "zz"
    assert Model([], []).predict("x") == ("und", 0.0)

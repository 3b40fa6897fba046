import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, simhash


@pytest.fixture(scope="module")
def fixture(spark, sf_dir, tmp_path_factory):
    """documents with hard cases, beside the benchmark."""
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = bench.orderBy("item_id").first().text
    odd = [(10_001, None, None, "s", 0), (10_002, "", "en", "s", 0), (10_003, "123 !!", "de", None, 6), (10_004, item, None, "s", 1), (10_005, f"{item} {item}", "en", "s", 1), (10_006, "the same words twice over and over", "en", "s", 1), (10_006, "the same words twice over and over", "en", "s", 1), (10_007, "The same words twice over and over", "en", "s", 1), (None, "an idless text of some words", None, None, None)]
    docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_against_brute_force(spark, fixture):
    docs = [tuple(r) for r in spark.read.parquet(f"{fixture}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{fixture}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    members = {}
    for k, root in enumerate(simhash.brute_groups([t for _, t in kept])):
        members.setdefault(root, []).append((kept[k][0] is None, kept[k][0] or 0, kept[k][0]))
    firsts = {min(rows)[2] for rows in members.values()}
    texts = {i: t for i, t in kept}
    clean = {r["doc_id"] for r in decontaminate.brute_force([(i, texts[i]) for i in firsts], bench) if not r["contaminated"]}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, fixture).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(clean, key=repr)
    for r in got:
        assert r.ids == model.encode(texts[r.doc_id]) and r.n_pieces == len(r.ids)
    assert not {10_001, 10_002, 10_003, 10_004, 10_005, 10_007} & {r.doc_id for r in got}


def test_stages_return_the_columns(spark, fixture):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{fixture}/documents.parquet").where("doc_id is null or doc_id < 30 or doc_id > 10000")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, fixture)
        assert out.schema == docs.schema
        assert stage(spark, docs.limit(0), fixture).count() == 0


def test_entry_lists_all():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 11)) and "pipeline" in e.queries()

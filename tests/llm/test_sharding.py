import pytest
from pyspark.sql import functions as F

from tessera.llm.sharding import Conflict, Shard, Store, compacted, merges, tiers


def shards(*sizes):
    return [Shard(f"p{k}", n, 1) for k, n in enumerate(sizes)]


def test_tiers_and_merges():
    assert [[s.bytes for s in t] for t in tiers(shards(10, 11, 12, 90, 100, 700, 2000), 1000, 5)] == [[10, 11, 12], [90, 100]]
    assert [[s.bytes for s in g] for g in merges(shards(*[100] * 9, 400), 400, 4, 64, 5)] == [[100] * 4, [100] * 4]
    assert merges(shards(1, 100, 10_000), 1 << 20, 4, 64, 1) == []
    assert [len(g) for g in merges(shards(*[1] * 10), 1 << 20, 4, 5, 10)] == [5, 5]


@pytest.fixture
def docs(spark):
    rows = [(k, f"text {k} " * (k % 7), None if k % 5 else "en") for k in range(500)] + [(None, None, None)] * 2 + [(1, "same", "en")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_appends_compaction_and_versions(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", target=20_000, small=10)
    for part in range(8):
        assert store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == part).coalesce(1)) == [part + 1]
    before = store.log.state()
    assert len(before.entries) == 8 and store.read().exceptAll(docs).count() == docs.exceptAll(store.read()).count() == 0
    version = store.compact()
    assert version == 9 and len(store.shards()) < 8 and sum(s.rows for s in store.shards()) == docs.count()
    assert docs.exceptAll(store.read()).count() == 0 and store.read(8).count() == docs.count() and 0 < store.read(1).count() < docs.count()
    with pytest.raises(Conflict):
        store.commit(before, [], [], before.meta["schema"])
    assert store.versions()[-1] == 9
    while store.compact():
        pass
    assert store.compact() is None
    assert store.vacuum() == 0 and store.read(8).count() == docs.count()  # all files are young
    last = store.versions()[-1]
    assert store.vacuum(hours=0) > 0 and docs.exceptAll(store.read()).count() == 0 and last in store.versions()
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.log.state() == store.log.state()


def test_lost_attempts_are_not_read(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append(docs)
    docs.write.parquet(f"file://{tmp_path}/s/data/orphan")
    assert store.read().count() == docs.count()
    assert store.vacuum() == 0 and store.vacuum(hours=0) > 0 and store.read().count() == docs.count()


def test_arrivals_by_column(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.append(docs, F.when(F.col("doc_id") > 100, F.col("doc_id") % 3)) == [1, 2, 3]
    assert docs.exceptAll(store.read()).count() == 0 and store.read().columns == docs.columns


def test_defined_cases(spark, docs, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read()
    assert store.append(docs.limit(0)) == [] and store.versions() == []
    store.append(docs)
    store.append(docs.select("lang", "text", "doc_id"))
    assert store.read().count() == 2 * docs.count() and store.read().columns == docs.columns
    with pytest.raises(ValueError):
        store.append(docs.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        store.append(docs.withColumn("__arrival", F.lit(1)))
    assert store.append(docs.limit(0)) == []


def test_no_python_runs(spark, docs, tmp_path):
    store = compacted(docs, f"file://{tmp_path}/s", F.col("doc_id") % 5)
    assert store.read(1).count() > 0 and len(store.versions()) > 5  # nothing was removed
    out = store.read()
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow")) and docs.exceptAll(out).count() == 0

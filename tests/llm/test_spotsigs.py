import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import spotsigs
from tessera.llm.spotsigs import NONE, brute_signatures, edited, fingerprint, likeness, linked, near_pairs, signatures


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["", None, "!!", "the", "The of And", "fox", "The quick fox and the lazy dog", "the THE quick. fox", "a b c d the e", "Über straße der Hund und die Katze", "日本 語 の", "words only here", "the fox " * 3000]


def test_signatures_against_sets_of_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").withColumn("s", signatures("text"))
    got = [r.s for r in df.orderBy("i").collect()]
    sets = [brute_signatures(t) for t in TEXTS]
    for k, a in enumerate(sets):
        assert got[k] == sorted(set(got[k])) and len(got[k]) == len(a)
        for j, b in enumerate(sets):
            assert jaccard(set(got[k]), set(got[j])) == jaccard(a, b)


def expected(rows):
    """edited text and next text by id; a repeated id's place is held by its text with the smallest hash."""
    order = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    first = {}
    for i, t in rows:
        first[i] = min(first.get(i, t or ""), t or "", key=lambda x: hashlib.md5(x.encode()).digest())
    out = []
    for i, t in rows:
        t, nxt = t or "", first[order[(order.index(i) + 1) % len(order)]]
        out.append((i, t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt))
    return out


@pytest.mark.parametrize("n, wide, step", [(1, 1000, 10), (2, 1, 3), (9, 1000, 10**17), (9, 2, 10)])
def test_edited_texts_and_order(spark, n, wide, step, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS", wide)
    rows = [(step * k - 30, f"text number {k} of the set " * (k + 1)) for k in range(n)] + ([(None, "x  y\n"), (7, None), (8, "é中\U0001F600abc"), (8, "é中\U0001F600abc")] if n > 2 else [])
    df = spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "doc_id long, text string, k string, bucket int, about int")
    got = edited(df).withColumn("own", likeness("sigs", "next_sigs")).collect()
    want = expected(rows)
    assert sorted(((r.doc_id, r.text, r.edited) for r in got), key=repr) == sorted((w[:3] for w in want), key=repr)
    by = {w[0]: w for w in want}
    for r in got:
        assert r.n_chars == len(r.text) and r.own == jaccard(brute_signatures(r.text), brute_signatures(by[r.doc_id][3]))
    assert edited(df.limit(0)).count() == near_pairs(df.limit(0))[0].count() == linked(df.limit(0)).count() == 0


def test_a_hot_id(spark):
    """Most rows have one id, or none: they get what follows it, and one of them stands before the others."""
    rows = [(7, f"text of the {k % 150} kind " * 3) for k in range(400)] + [(None, f"none of the {k % 120}") for k in range(300)] + [(k, f"a text of number {k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = edited(docs).collect()
    assert sorted(((r.doc_id, r.text, r.edited) for r in got), key=repr) == sorted((w[:3] for w in expected(rows)), key=repr)
    by = {w[0]: w[3] for w in expected(rows)}
    sigs = {x.t: x.s for x in spark.createDataFrame([(t,) for t in set(by.values())], "t string").select("t", signatures("t").alias("s")).collect()}
    assert all(r.next_sigs == sigs[by[r.doc_id]] for r in got)



def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    out = QUERIES["op10_spotsigs"](spark, sf_dir)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, t, e, nxt in expected(rows):
        r, own = got[i], brute_signatures(t)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and len(r.fingerprint) == 16 * len(own)
        assert r.near_edited == jaccard(own, brute_signatures(e)) and r.near_next == jaccard(own, brute_signatures(nxt))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("often", [3, 1000])
def test_pairs_lose_none(spark, often, monkeypatch):
    """All pairs of 400 documents, among them the null and repeated ids, whichever signatures count as common."""
    monkeypatch.setattr(spotsigs, "OFTEN", often)
    odd = [(None, None), (-2, ""), (-3, "the same of it"), (-4, "the same of it"), (None, "the same of it"), (None, "an other of them that is new"), (-5, "x y z of a"), (-5, "the cat and the dog of it")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    sets = [brute_signatures(t) for _, t in rows]
    classes = sorted(set(sets), key=sorted)
    for least in (0.5, 0.8):
        pairs, members = near_pairs(docs, least)
        marks = {(r.k, r.h): r for r in members.collect()}
        place = lambda i, t: (NONE if i is None else i, hashlib.md5((t or "").encode()).hexdigest())
        mark = {s: marks[place(i, t)].mark for (i, t), s in zip(rows, sets, strict=True)}
        for (i, t), s in zip(rows, sets, strict=True):
            assert marks[place(i, t)].class_id == min((k for (k, _), x in zip(rows, sets, strict=True) if x == s and k is not None), default=None)
        want = {frozenset((mark[x], mark[y])): jaccard(x, y) for k, x in enumerate(classes) for y in classes[k + 1 :] if x and y and jaccard(x, y) >= least}
        found = pairs.collect()
        assert {frozenset((r.class_mark, r.other_mark)): r.likeness for r in found} == want and len(found) == len(want) > 3
        links = {(NONE if r.doc_id is None else r.doc_id, r.h): r for r in linked(docs, least).collect()}
        for (i, t), s in zip(rows, sets, strict=True):
            assert links[place(i, t)].n_links == sum(mark[s] in p for p in want)


def test_fingerprint_text(spark):
    row = spark.createDataFrame([(["ab", "cd"],), ([],)], "s array<string>").select(fingerprint("s").alias("f"), F.size("s").alias("n")).orderBy("n").collect()
    assert [r.f for r in row] == ["", "abcd"]
    sig = spark.createDataFrame([("The Quick fox",)], "t string").select(signatures("t").alias("s")).first().s
    assert sig == sorted(hashlib.md5(x).hexdigest()[:16] for x in (b" quick fox", b"the quick fox"))

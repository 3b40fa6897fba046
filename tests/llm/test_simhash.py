import random

import numpy as np
import pytest

from tessera.llm import simhash
from tessera.llm.simhash import brute_force, brute_groups, collisions, components, deduplicated, fingerprint, fingerprinted, forest, grouped, linked, masks, nearest, shingles, signature, star_edges


def near(prints, radius):
    """Components of 64-bit values by all pairs."""
    up = {p: p for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius and up[a] != up[b]:
                old, new = max(up[a], up[b]), min(up[a], up[b])
                up = {k: new if v == old else v for k, v in up.items()}
    return up


def flipped(x, n, r):
    for k in r.sample(range(64), n):
        x ^= 1 << k
    return x


@pytest.fixture
def prints():
    r, out = random.Random(7), set()
    for _ in range(12):
        x = r.getrandbits(64)
        out |= {x, *(flipped(x, r.randint(1, 6), r) for _ in range(8))}
    return sorted(out | {0, (1 << 64) - 1, 1, 1 << 63})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_lose_no_component(spark, prints, radius):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")
    for leaf in (1 << 21, 3000) if radius in (2, 4) else (1 << 21,):  # the small one splits prefixes within tasks
        roots = {r.node: r.root for r in components(linked(df, radius, leaf)).collect()}
        want = near(prints, radius)
        groups = {}
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
        for own in groups.values():
            assert len({roots.get(signed(p), signed(p)) for p in own}) == 1
        assert len({roots.get(signed(p), signed(p)) for p in prints}) == len(groups)


def test_star_edges_are_true_links(prints):
    own = np.array(prints, np.uint64)
    for prefix in range(16):
        for edges in star_edges(own, prefix, 4, 2, 4, 5000):
            assert all((a ^ b).bit_count() <= 4 for a, b in edges.tolist())
    assert len(masks(64, 2)) == 1 + 64 + 2016
    assert len(forest(np.array([[1, 2], [2, 3], [1, 3]], np.uint64))) == 2


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*chain, *star, (7, 7), (500, 501), (501, 500)], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[100 + k] == 100 for k in range(60)) and got[501] == got[500] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint():
    import xxhash

    assert fingerprint(None) == fingerprint("") == fingerprint(" \t\n") == 0
    assert fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42) == fingerprint("one\x0btwo\n")
    assert fingerprint("É b") == xxhash.xxh64_intdigest("É b".encode(), 42)
    words = "a b c d e f a b c d e f".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    assert fingerprint(" ".join(words)) == want
    assert fingerprint("x y z w " * 100_000) == fingerprint("x y z w " * 200_000)


def test_defined_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (None, None), (2, ""), (3, "x y z w v"), (3, "q r s"), (None, "solo one")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, fingerprint int")
    got = sorted(((r.doc_id, r.component_id) for r in grouped(df).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (None, 2), (None, 2), (2, 2), (3, 3), (3, 3), (None, None)], key=repr)
    kept = deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, "a b c"), (2, ""), (3, "x y z w v"), (3, "q r s"), (None, "solo one")], key=repr)
    assert grouped(df.limit(0)).count() == deduplicated(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fingerprint"):
        fingerprinted(df)


def test_columns_stay_as_they_are(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "b", {"x": 1}, None), (1, text, "a", {"x": 2}, 5), (1, text, "a", {"x": 2}, 5), (2, text, "c", None, 5), (None, "another text than those", "d", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __made map<string,int>, __text_hash int")
    got = deduplicated(df)
    assert got.schema == df.schema
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 2 and all(k in rows for k in kept) and {k[0] for k in kept} == {1, None}
    # of rows of one id and text the same one stays, however the rows are dealt
    assert all({r["__key"] for r in deduplicated(df.repartition(n)).collect()} == {k[2] for k in kept} for n in (1, 5))


def test_signatures_tell_the_similarity():
    r = random.Random(4)
    for share in (0.7, 0.8, 0.9):
        errors = []
        for _ in range(40):
            n = r.randint(80, 400)
            both = int(2 * n * share / (1 + share))
            pool = np.array([r.getrandbits(64) for _ in range(2 * n - both)], np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
            distance = int(np.bitwise_count(signature(a).view(np.uint64) ^ signature(b).view(np.uint64)).sum())
            common = np.cos(np.pi * distance / (64 * simhash.WORDS)) * np.sqrt(len(a) * len(b))
            errors.append(common / (len(a) + len(b) - common) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert len(shingles(None)) == len(shingles(" ")) == 0 and len(shingles("a b c")) == 1 and len(shingles("a b c d e f f")) == 3


def test_collisions_find_all_within_one_flip_each():
    r = random.Random(9)
    words = []
    for _ in range(30):
        x = r.getrandbits(32)
        words += [x, x ^ 1 << r.randrange(32), x ^ 1 << r.randrange(32) ^ 1 << r.randrange(32)]
    words = np.array(words, np.uint32)
    far = 64  # all sketches are near: each bucket is a star
    for leaf in (1 << 21, 50):
        up = list(range(len(words)))
        for prefix in range(4):
            for found in collisions(words, np.zeros(len(words), np.uint64), prefix, 2, far, leaf):
                assert all((int(words[a]) ^ int(words[b])).bit_count() <= 2 for a, b, _ in found.tolist())
                for a, b, _ in nearest(found).tolist():
                    x, y = up[a], up[b]
                    up = [min(x, y) if k in (x, y) else k for k in up]
        for a in range(len(words)):
            for b in range(a):
                if (int(words[a]) ^ int(words[b])).bit_count() <= 2:
                    assert up[a] == up[b]
    # a sketch that is far has its own turn: what is like it is found
    sketches = np.array([0, (1 << 64) - 1, 0, (1 << 64) - 2], np.uint64)
    (found,) = collisions(np.full(4, 5, np.uint32), sketches, 0, 1)
    assert sorted(tuple(x[:2]) for x in found.tolist()) == [(2, 0), (3, 1)]


def test_near_copies_against_all_pairs(spark):
    """Exact similarity of all pairs decides; the search may lose a few that lie at the threshold."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    r = random.Random(6)
    long = [t for _, t in rows if len(t.split()) > 60][:150]
    for k, t in enumerate(long):  # copies with some words changed
        words = t.split()
        for _ in range(1 + len(words) // 200 * (k % 4)):
            words[r.randrange(len(words))] = "changed"
        rows.append((10_000 + k, " ".join(words)))
    kept = {x.doc_id for x in deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {rows[k][0] for k in brute_groups([t for _, t in rows])}
    assert want <= kept and len(kept - want) <= 0.01 * (len(rows) - len(want))


def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()}
    want = brute_force(texts)
    assert got == {i: (f"{fingerprint(t):016x}", want[i]) for i, t in texts}

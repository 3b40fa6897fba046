"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: words are runs of characters other than space and U+0009-U+000D, A-Z lower-cased; every 4 consecutive words
(repeats included, joined by a space; all of them where there are fewer) are hashed with XXH64, seed 42; a bit is 1 if it
is set in over half the hashes. No words, null included: zero.

Links: two fingerprints within ``radius`` bits have a middle within half the radius of both, so each distinct fingerprint
stands for all its variants within half the radius, and equal variants collide. All members of one variant lie within the
radius of each other, so a star to the smallest of them keeps every component without listing pairs. The variants are
dealt by their leading bits: a fingerprint goes once to each prefix that its ball touches, and the receiving task makes
the variants that have the prefix, sorts them, and verifies the distance of each star edge. The number of leading bits
follows the number of fingerprints; a prefix with too many variants is split by further bits inside its task, so memory
is bounded for any data. Equal fingerprints (exact copies) are one node, counted before any shuffle of balls.

Components of the edges come from alternating large and small stars over Spark tables; each round is written to the
shared folder, and the one before is removed.

``deduplicated`` finds near copies of any similarity: one fingerprint of 64 bits would need a radius of 13 bits for a Jaccard
coefficient of 0.8, whose ball has 10^13 variants, and random texts would meet in it. So a long fingerprint of many words
is taken of the set of five-word shingles; the 32-bit halves of some are tables of their own, each with balls of radius 1
(a collision links at up to 2 bits), of which a pair needs to meet in one: at 0.8 nine in ten do, at 0.85 99 in 100.
Colliding pairs are verified by a sketch where they meet, then by whole fingerprints, then by their sets of shingles. The
32 bits suit some 10^9 distinct texts; beyond, chance collisions grow with the square of their number.

Defined cases: rows with a null doc_id are linked like others, and component_id is the smallest id that is not null (null
if there is none); a null or empty text has no words, and all such are copies of each other; texts of any length are read
whole; repeated ids and texts keep all their rows in ``grouped``, and ``deduplicated`` says which one stays; an empty table
gives an empty result. ``grouped`` reads doc_id and text alone; ``deduplicated`` keeps all columns as they are, whatever
their names, and ``fingerprinted`` refuses a table that has its column already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import delete, matched, refuse, staged, staged_at, unused

SHINGLE = 4
#: Variants that a task sorts at once (16 bytes each, and as much again while sorting).
LEAF = 1 << 21
#: Words of a long fingerprint, and tables: 32-bit halves of the first ones. The word after those is the sketch; sketches of a
#: link differ in at most so many bits.
WORDS, TABLES, FAR = 22, 20, 19
#: How far below the similarity asked for a pair may lie by its fingerprints (about four standard errors) to be verified.
MARGIN = 0.1
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    import xxhash

    own = (text or "").encode().lower().split()
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in own])
        starts = [0, *(ends[:-size]).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    held = np.array(hashes, ">u8")
    for k in range(0, len(held), 1 << 16):
        ones += np.unpackbits(held[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held)).view(">u8")[0])


def fingerprinted(docs: DataFrame, name: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed long."""
    from pyspark.sql.functions import arrow_udf

    refuse(docs, name)

    @arrow_udf("bigint")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(np.array([fingerprint(x.as_py(), size) for x in part], np.uint64).view(np.int64), pa.int64())

    return docs.withColumn(name, made("text"))


def as_hex(column: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def masks(bits: int, flips: int) -> np.ndarray:
    """All words with at most so many bits set among the low ones."""
    return np.array([sum(1 << i for i in at) for n in range(flips + 1) for at in combinations(range(bits), n)], np.uint64)


def star_edges(prints: np.ndarray, prefix: int, lead: int, half: int, radius: int, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """Edges (larger, smaller) of those distinct fingerprints whose variants with the leading bits collide."""
    if not 0 < lead < 64:
        raise ValueError("lead must be 1 to 63")
    low = 64 - lead
    far = np.bitwise_count((prints >> np.uint64(low)) ^ np.uint64(prefix))
    sizes = [len(masks(low, half - d)) if (far == d).any() else 0 for d in range(half + 1)]
    total = sum(n * int((far == d).sum()) for d, n in enumerate(sizes))
    if (far <= half).sum() < 2:
        return
    if total > leaf and lead < 62:
        near = prints[far <= half]
        for more in range(4):
            yield from star_edges(near, prefix << 2 | more, lead + 2, half, radius, leaf)
        return
    values, owners = [], []
    for d in range(half + 1):
        own = prints[far == d]
        if len(own):
            base = (own & np.uint64((1 << low) - 1)) | np.uint64(prefix << low)
            made = base[:, None] ^ masks(low, half - d)[None, :]
            values.append(made.ravel())
            owners.append(np.repeat(own, made.shape[1]))
    variants, owner = np.concatenate(values), np.concatenate(owners)
    ordered = np.sort(variants)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, variants), len(twice) - 1)
    hit = twice[at] == variants
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    first = np.concatenate(([True], at[1:] != at[:-1]))
    least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    edges = np.unique(np.stack([owner[~first], least[~first]], 1), axis=0)
    yield edges[np.bitwise_count(edges[:, 0] ^ edges[:, 1]) <= radius]


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges that keep the same components, at most one fewer than nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for a, b in edges.tolist():
        if (ra := root(a)) != (rb := root(b)):
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def linked(prints: DataFrame, radius: int = 4, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fingerprint), enough for the components."""
    half = (radius + 1) // 2
    n = prints.count()
    lead = min(40, max(4, int(np.ceil(np.log2(max(1, n * len(masks(64, half)) / leaf))))))
    touched = F.array(*[F.lit(int(x)) for x in masks(lead, half)])
    dealt = prints.select("fingerprint", F.explode(F.transform(touched, lambda m: F.shiftrightunsigned("fingerprint", 64 - lead).bitwiseXOR(m))).alias("prefix"))

    def edges_of(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.unique(rows.column("fingerprint").to_numpy().view(np.uint64))
        held = np.zeros((0, 2), np.uint64)
        for found in star_edges(own, key[0].as_py(), lead, half, radius, leaf):
            held = forest(np.concatenate([held, found])) if len(found) else held
        return pa.table({"a": held[:, 0].view(np.int64), "b": held[:, 1].view(np.int64)})

    return dealt.groupBy("prefix").applyInArrow(edges_of, "a bigint, b bigint")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): each node that has an edge and the smallest node of its component, by large and small stars."""
    edges, path = staged_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
        small = large.join(least, "a").select(F.explode(both).alias("e")).select("e.*").where("a <> b").distinct()
        old, (edges, path) = path, staged_at(small, name)
        delete(edges.sparkSession, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fingerprint, root) of each distinct value of column fingerprint: equal roots are one component."""
    nodes = staged(prints.select("fingerprint").distinct(), "nodes")
    roots = components(linked(nodes, radius)).withColumnRenamed("node", "fingerprint")
    return nodes.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def grouped(docs: DataFrame, radius: int = 4, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of docs (doc_id, text)."""
    prints = staged(fingerprinted(docs.select("doc_id", "text"), size=size).select("doc_id", "fingerprint"), "fingerprints")
    placed = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    placed = staged(placed.join(rooted(prints, radius), "fingerprint"), "placed")
    ids = staged(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    found = placed.agg(F.count(F.lit(1)), F.sum("n")).first()
    named = matched(placed.withColumnRenamed("n", "rows"), ids, "root", found[0]).select("fingerprint", "component_id", F.col("rows").alias("n"))
    return matched(prints, named, "fingerprint", found[1] or 0).select("doc_id", "fingerprint", "component_id")


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The XXH64 hashes of a text's distinct shingles of so many words (as in ``fingerprint``), in order."""
    import xxhash

    own = (text or "").encode().lower().split()
    joined, digest = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= size:
        return np.array([digest(joined, 42)] if own else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own])
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip([0, *ends[:-size].tolist()], (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64))


def signature(held: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A long fingerprint of so many 64-bit words: of a set of shingles under as many hash functions, each of which mixes the hashes anew."""
    ones = np.zeros(64 * words, np.int64)
    for k in range(0, len(held), 255):  # as many as a byte counts
        x = held[k : k + 255, None] + MIX * np.arange(1, words + 1, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(held)).view(np.int64)


def shingled(docs: DataFrame, name: str, size: int = 5) -> DataFrame:
    """docs with the shingles of each text."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<bigint>")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            out = [shingles(x.as_py(), size).view(np.int64) for x in part]
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))

    return docs.withColumn(name, made("text"))


def signed(docs: DataFrame, name: str, size: int = 5, words: int = WORDS) -> DataFrame:
    """docs with a struct of n (distinct shingles) and w (the words of the long fingerprint)."""
    from pyspark.sql.functions import arrow_udf

    kind = [pa.field("n", pa.int64()), pa.field("w", pa.list_(pa.int64()))]

    @arrow_udf("struct<n:bigint,w:array<bigint>>")
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            sets = [shingles(x.as_py(), size) for x in part]
            out = [(len(x), signature(x, words)) for x in sets]
            flat = np.concatenate([np.zeros(0, np.int64), *(w for _, w in out)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * words, pa.int32()), pa.array(flat))
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), lists], fields=kind)

    return docs.withColumn(name, made("text"))


def collisions(words: np.ndarray, sketches: np.ndarray, prefix: int, lead: int, far: int = FAR, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """(larger place, smaller place, distance) of those 32-bit words that share a variant with the leading bits, one bit off
    at most, and whose sketches are near. Of a variant's holders, the first is compared with all; those it isn't near to
    have their turn in the same way, so a link is lost only where both its ends are near to others.
    """
    low = 32 - lead
    off = np.bitwise_count((words >> np.uint32(low)) ^ np.uint32(prefix))
    near = np.flatnonzero(off <= 1)
    if len(near) < 2:
        return
    if len(near) * (low + 1) > leaf and lead < 30:
        for more in range(4):
            for found in collisions(words[near], sketches[near], prefix << 2 | more, lead + 2, far, leaf):
                yield np.concatenate([near[found[:, :2]], found[:, 2:]], 1)
        return
    keys = []
    for d, flips in ((0, np.append(0, np.uint32(1) << np.arange(low, dtype=np.uint32))), (1, np.zeros(1))):
        at = np.flatnonzero(off == d)
        made = (words[at] & np.uint32((1 << low) - 1))[:, None] ^ flips.astype(np.uint32)[None, :]
        keys.append((made.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64)[:, None]).ravel())
    keys = np.sort(np.concatenate(keys))
    same = keys[1:] >> np.uint64(32) == keys[:-1] >> np.uint64(32)
    mine = np.concatenate((same, [False])) | np.concatenate(([False], same))
    bucket, at = keys[mine] >> np.uint64(32), (keys[mine] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    done = np.zeros(len(at), bool)
    edges = []
    while len(at):
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        group = np.cumsum(np.concatenate(([True], bucket[1:] != bucket[:-1]))) - 1
        place = np.where(done, len(at), np.arange(len(at)))
        head = np.minimum.reduceat(place, start)  # the first that hasn't had a turn or a neighbour
        there = head[group] < len(at)
        bucket, at, done, head = bucket[there], at[there], done[there], (head[group[there]] - np.flatnonzero(~there).searchsorted(head[group[there]]))
        if not len(at):
            break
        distance = np.bitwise_count(sketches[at] ^ sketches[at[head]])
        own = np.arange(len(at)) == head
        hit = (distance <= far) & ~own
        edges.append(np.stack([np.maximum(at[hit], at[head[hit]]), np.minimum(at[hit], at[head[hit]]), distance[hit].astype(np.int64)], 1))
        done |= hit | own
    found = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 3), np.int64)
    if len(found):
        yield found


def nearest(edges: np.ndarray) -> np.ndarray:
    """Of (a, b, distance), those that connect the same parts at every distance: a forest of the least ones."""
    return edges[np.sort(_spanning(edges[np.argsort(edges[:, 2], kind="stable"), :2], np.argsort(edges[:, 2], kind="stable")))]


def _spanning(pairs: np.ndarray, places: np.ndarray) -> np.ndarray:
    up: dict[int, int] = {}
    kept = []
    for (a, b), place in zip(pairs.tolist(), places.tolist(), strict=True):
        while (x := up.get(a, a)) != a:
            up[a] = up.get(x, x)
            a = x
        while (x := up.get(b, b)) != b:
            up[b] = up.get(x, x)
            b = x
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(place)
    return np.array(kept, np.int64)


def likeness(a: str, b: str, n: str, m: str, words: int = WORDS) -> Column:
    """SQL of the Jaccard coefficient that two long fingerprints (a, b) of sets of n and m shingles tell."""
    distance = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    common = f"cos(pi() * {distance} / {64 * words}) * sqrt({n} * {m})"
    return F.expr(f"transform(array({common}), c -> c / ({n} + {m} - c))[0]")


def alike(nodes: DataFrame, least: float = 0.8, words: int = WORDS, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) among nodes (node, n, w; distinct) whose long fingerprints tell a Jaccard coefficient of ``least`` or more.

    Each 32-bit half of the first words is a table of its own for ball hashing at radius 2: a node goes to the tasks of the
    leading bits that its ball touches, where variants within one bit collide and a sketch (one more word) verifies them.
    Edges found are verified by whole fingerprints.
    """
    n = nodes.count()
    lead = min(28, max(1, int(np.ceil(np.log2(max(1, n * 33 / leaf))))))
    word = "cast(shiftrightunsigned(w[t div 2], 32 * (t % 2)) & 4294967295L as bigint)"
    flips = ", ".join(str(x) for x in (0, *(1 << k for k in range(lead))))
    dealt = nodes.select("node", F.expr(f"w[{tables // 2}]").alias("sketch"), "w", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))).alias("t"))
    dealt = dealt.select("node", "sketch", "t", F.expr(word).cast("bigint").alias("word"))
    dealt = dealt.select("node", "sketch", "word", F.expr(f"explode(transform(array({flips}), m -> t * {1 << lead}L + (shiftrightunsigned(word, {32 - lead}) ^ m)))").alias("place"))

    def edges_of(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.column("node").to_numpy()
        # who is first in one table is not first in all: there are four orders
        order = np.argsort(own.view(np.uint64) * (MIX + np.uint64(2 * (key[0].as_py() >> lead & 3))))
        own, sketches = own[order], rows.column("sketch").to_numpy()[order].view(np.uint64)
        held = np.zeros((0, 3), np.int64)
        for found in collisions(rows.column("word").to_numpy()[order].astype(np.uint32), sketches, key[0].as_py() & ((1 << lead) - 1), lead, leaf=leaf):
            held = nearest(np.concatenate([held, found]))
        a, b = own[held[:, 0]], own[held[:, 1]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    found = dealt.groupBy("place").applyInArrow(edges_of, "a bigint, b bigint").distinct()
    ends = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("w").alias(f"w_{x}")) for x in "ab"]
    return found.join(ends[0], "a").join(ends[1], "b").where(likeness("w_a", "w_b", "n_a", "n_b", words) >= least).select("a", "b")


def verified(found: DataFrame, texts: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """Those of the edges (a, b) whose texts' shingles have a Jaccard coefficient of ``least`` or more. texts: node, text, no node twice."""
    sets = staged(shingled(texts, "s", size).select("node", "s"), "shingles")
    ends = [sets.select(F.col("node").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab"]
    common = F.size(F.array_intersect("s_a", "s_b"))
    return found.join(ends[0], "a").join(ends[1], "b").where(common >= F.lit(least) * (F.size("s_a") + F.size("s_b") - common) - 1e-9).select("a", "b")


def deduplicated(docs: DataFrame, least: float = 0.8, size: int = 5, words: int = WORDS) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id (null last), then the smallest text hash.

    Near copies are texts whose sets of shingles have a Jaccard coefficient of ``least`` or more, and groups what such pairs
    connect. Pairs are found by ``alike``, a little below that coefficient, and verified by their sets. Texts with the same
    long fingerprint, exact copies among them, are one node. Rows that repeat wholly are one; of rows that repeat an id and
    a text and differ elsewhere, that with the smallest hash of all columns counts.
    """
    key, made = unused(docs, "key"), unused(docs, "made")
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in hashed], *[F.col(f"`{c}`").isNull() for c in hashed])
    keyed = docs.withColumn(key, F.concat_ws("-", F.sha1(F.coalesce(F.col("text"), F.lit(""))), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.hex(whole)))
    own = keyed.select("doc_id", F.col(key).alias("key"), "text")
    prints = signed(own, made, size, words)
    prints = staged(prints.select("doc_id", "key", F.col(f"{made}.n").alias("n"), F.col(f"{made}.w").alias("w")), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    nodes = prints.groupBy(F.xxhash64("n", "w").alias("node")).agg(F.first("n").alias("n"), F.first("w").alias("w"), first)
    nodes = staged(nodes, "nodes")
    found = staged(alike(nodes.select("node", "n", "w"), least - MARGIN, words), "alike")
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("first.key").alias("key")), "node")
    ends = staged(ends, "ends")
    some = ends.count() <= 500_000  # 60 MB at most
    texts = own.join(F.broadcast(ends) if some else ends, "key").select("node", "text").dropDuplicates(["node"])
    roots = components(verified(found, texts, least, size), "edges").select("node", "root")
    kept = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.key").alias(key))
    # one exchange of the rows, by their key
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[f"`{c}`" for c in docs.columns])


def brute_groups(texts: list[str | None], least: float = 0.8, size: int = 5) -> list[int]:
    """The smallest place of each text's group, by comparing all pairs of shingle sets; for tests."""
    sets = [frozenset(shingles(t, size).tolist()) for t in texts]
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                i, j = root(a), root(b)
                up[max(i, j)] = min(i, j)
    return [root(x) for x in range(len(sets))]


def brute_force(texts: list[tuple], radius: int = 4) -> dict[int, int]:
    """Component of each id by comparing all pairs; for tests."""
    prints = {i: fingerprint(t) for i, t in texts}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group

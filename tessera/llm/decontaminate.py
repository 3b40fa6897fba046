"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters. Every 13 consecutive
words of an item (all of them where an item has fewer) are a pattern; the automaton over all patterns reads each
normalised text once. Matches are mapped from the normalised text to words, and from words to offsets in the original.

Defined cases: a null or empty text has no words, no hits and is clean; an item without words has no window; an item
without an id is no item; repeated items count once, repeated documents each; an empty table of documents stays empty,
and one of items hits nothing; a text of any length is scanned whole; windows that several items share hit for each; a
column of a result's name is an error unless a prefix is given. The automaton is held in memory by every Python worker (some 60
bytes a character), so items are taken in blocks of at most ``block_chars`` characters of patterns: a larger benchmark means more blocks, each scanning the text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import refuse, unused

WINDOW = 13
#: What each ASCII byte becomes; other bytes stay.
NORMAL = bytes(c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
STATE = "struct<n_words:bigint,ranges:array<int>,items:array<string>,spans:array<struct<start:int,end:int>>>"


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: Iterator[tuple[str, str | None]], size: int = WINDOW) -> dict[str, tuple[int, set[str]]]:
    """Pattern text (bytes as Latin-1) to its number of words and the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        own = words((text or "").encode())
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            key = (b" " + b" ".join(own[i : i + n]) + b" ").decode("latin-1")
            found.setdefault(key, (n, set()))[1].add(item)
    return found


def automaton(found: dict[str, tuple[int, set[str]]]):
    import ahocorasick

    built = ahocorasick.Automaton()
    for key, value in found.items():
        built.add_word(key, value)
    if found:
        built.make_automaton()
    return built


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(built, text: bytes, before: dict | None = None) -> dict:
    """Hit word ranges (both ends included), items, and their spans as character offsets of the original text."""
    flat = text.translate(NORMAL)
    parts = flat.split()
    hits, items = [], set()
    if parts and len(built):
        normal = b" " + b" ".join(parts) + b" "
        at = None
        for end, (n, own) in built.iter(normal.decode("latin-1")):
            if at is None:
                at = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
            last = int(np.searchsorted(at, end)) - 1
            hits.append((last - n + 1, last))
            items |= own
    if before is not None:
        hits += list(zip(before["ranges"][::2], before["ranges"][1::2], strict=True))
        items |= set(before["items"])
    ranges = merged(hits)
    spans = []
    if ranges:
        solid = np.concatenate(([0], (np.frombuffer(flat, np.uint8) != 32).astype(np.int8), [0]))
        edge = np.diff(solid)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        char = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        spans = [{"start": int(char[starts[a]]), "end": int(char[ends[b]])} for a, b in ranges]
    return {"n_words": len(parts), "ranges": [x for r in ranges for x in r], "items": sorted(items), "spans": spans}


def _blocks(rows: Iterator, size: int, block_chars: int) -> Iterator[dict]:
    """Patterns of as many items as fit a block; an item is never split from its own windows."""
    block: dict[str, tuple[int, set[str]]] = {}
    held = 0
    for row in rows:
        for key, (n, own) in patterns([(row["item"], row["text"])], size).items():
            if key not in block:
                if held and held + len(key) > block_chars:
                    yield block
                    block, held = {}, 0
                held += len(key)
            block.setdefault(key, (n, set()))[1].update(own)
    yield block


def scanned(text: Column, benchmark: DataFrame, size: int = WINDOW, block_chars: int = 4_000_000) -> Column:
    """Column STATE of each text. benchmark (item_id, text) is read by the driver one partition at a time."""
    from pyspark.sql.functions import arrow_udf

    spark: SparkSession = benchmark.sparkSession
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    kind = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
    out: Column | None = None
    for block in _blocks(rows.toLocalIterator(), size, block_chars):
        held = spark.sparkContext.broadcast(block)

        def step(parts, held=held):
            built = automaton(held.value)
            for part in parts:
                texts, before = part if isinstance(part, tuple) else (part, None)
                old = before.to_pylist() if before is not None else None
                yield pa.array([scan(built, (x.as_py() or "").encode(), old[i] if old else None) for i, x in enumerate(texts)], kind)

        if out is None:

            @arrow_udf(STATE)
            def first(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                yield from step(parts)

            out = first(text)
        else:

            @arrow_udf(STATE)
            def next_(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                yield from step(parts)

            out = next_(text, out)
    assert out is not None
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, block_chars: int = 4_000_000, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted as strings), spans and contaminated.

    A document is contaminated if a word of it is hit and at least one of ``share`` words is. The names added are
    prefixed with ``prefix``, which a table needs that has such columns already.
    """
    refuse(docs, *[prefix + x for x in ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")])
    tmp = unused(docs, "scan")
    state = lambda name: F.col(f"`{tmp}`.{name}")
    hit = F.aggregate(F.expr(f"transform(sequence(1, size(`{tmp}`.ranges) div 2), i -> `{tmp}`.ranges[2 * i - 1] - `{tmp}`.ranges[2 * i - 2] + 1)"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    out = docs.withColumn(tmp, scanned(F.col("text"), benchmark, size, block_chars))
    out = out.withColumn(f"{prefix}n_words", state("n_words")).withColumn(f"{prefix}n_hit", F.when(F.size(state("ranges")) > 0, hit).otherwise(F.lit(0).cast("bigint")))
    out = out.withColumn(f"{prefix}n_items", F.size(state("items")).cast("bigint")).withColumn(f"{prefix}items", state("items")).withColumn(f"{prefix}spans", state("spans"))
    n_hit, n_words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return out.withColumn(f"{prefix}contaminated", (n_hit > 0) & (F.lit(share) * n_hit >= n_words)).drop(tmp)


def brute_force(docs: list[tuple], benchmark: list[tuple], size: int = WINDOW, share: int = 20) -> list[dict]:
    """The same by trying every window at every word; for tests."""
    out = []
    wins = [(str(i), tuple(w[k : k + min(size, len(w))])) for i, t in benchmark if i is not None and (w := words((t or "").encode())) for k in range(len(w) - min(size, len(w)) + 1)]
    for doc_id, text in docs:
        own = words((text or "").encode())
        hit, items = set(), set()
        for item, win in wins:
            for k in range(len(own) - len(win) + 1):
                if tuple(own[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    items.add(item)
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        contaminated = bool(hit) and share * len(hit) >= len(own)
        out.append({"doc_id": doc_id, "n_words": len(own), "n_hit": len(hit), "n_items": len(items), "items_sha256": digest, "contaminated": contaminated})
    return out

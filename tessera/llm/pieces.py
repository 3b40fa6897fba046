"""SentencePiece encoding and decoding over a relational lattice.

Words: a model's pieces never join a letter to another kind of character, nor any character to a following word mark
(checked when the model is loaded), so a text splits into units that are encoded on their own, each once. The distinct
units' substrings of at most the longest piece's length are exploded and equi-joined to the piece table; the edges found
are grouped by unit and folded by Viterbi with the higher-order ``aggregate``: from left to right, the best path to each
position is the best path to the start of one of the edges that end there, and that edge.

Costs: of a BPE model, a path's cost is of its neighbouring pieces: nothing where merging leaves two of them apart, infinite
where it would join across their border. The path of no cost is the only one to each position, and is what the library
gives. (The sum of scores, which a unigram model's paths cost, gives other pieces than the library for a BPE model.) Two
pieces stay apart unless some edge across the border is merged first: before its left part is merged with what is left of
it in the left piece, and no later than its right part in the right one (of equal ranks, which runs of word marks have, the
leftmost is merged first). So the piece table has for each piece the rank
at which its parts at either end are merged on (``ls`` by where a part at the start ends, ``rs`` by where one at the end
starts). Only BPE models can be encoded; ``Model`` refuses all others. Characters without a piece become byte pieces.

Units are distinct within an input split (file and block), so each split has a table of its own units, as large as its
text at most. It's written to the shared folder and read by the task of the split, and no text is shuffled. A table that
is no plain scan of files is written to the shared folder first. If the files are cut into other splits when the result is
computed (the session's parallelism has changed), that is an error. Units of over ``LONG`` characters are merged by rank
with a heap in Python, as the fold over their lattice takes the square of their length.

Defined cases: a null text has null ids, an empty one none; any other text is read whole. Rows that repeat have their ids
each; an empty table stays empty. Extra columns stay as they are, and a column that has
the result's name already is an error. Decoding turns word marks to spaces, drops the first one, and restores bytes; ids
of controls give nothing.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import file_system, refuse, release, scratch, small_batches, staged

MARK = "▁"
LONG = 128
#: The rank of what is never merged.
NEVER = (1 << 31) - 1
#: Code points whose pieces are found by their number, and what stands for no piece.
CODES, NONE = 0x500, 0xFFFFFF
#: Words that a task gathers before it cuts them, and bytes of text that it takes at once; looking units up takes more at once,
#: as each time goes through the whole table of the split.
WORDS, TEXT, LOOKED = 1 << 17, 2 << 20, 4 << 20
#: Partitions of the units for each of the session's: a unit's lattice is many times as large as the unit.
FINER = 4
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNITS = rf"{MARK}*[\p{{L}}\p{{M}}]+|{MARK}*[^\p{{L}}\p{{M}}{MARK}]+|{MARK}+"
#: Some letters and some other characters; words of letters, then others are cut without UNITS.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-@\[-`{-~"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    import struct

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return out, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        elif key & 7 in (1, 5):
            size = 8 if key & 7 == 1 else 4
            value, at = struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Model:
    """Pieces of a BPE model with byte pieces, no normalisation and a leading word mark."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for key, value in fields(data):
            if key == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif key == 2:
                trainer = dict(fields(value))
            elif key == 3:
                normalizer = dict(fields(value))
        bytes_ = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if trainer.get(3) != 2 or len(bytes_) < 256 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only BPE models with byte pieces, a leading mark, kept white space and no normalisation are known")
        self.bytes = [bytes_[b] for b in range(256)]
        self.table = {p: (score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind == NORMAL}
        order = {score: k for k, score in enumerate(sorted({score for score, _ in self.table.values()}, reverse=True))}
        self.ranks = {p: order[score] for p, (score, _) in self.table.items()}
        self.longest = max(map(len, self.table))
        self.single = {p: i for p, (_, i) in self.table.items() if len(p) == 1}
        for p in self.table:
            kinds = {unicodedata.category(c)[0] in "LM" for c in p.lstrip(MARK)}
            if MARK in p.lstrip(MARK) or len(kinds) > 1:
                raise ValueError(f"the piece {p!r} joins what units split")
        self._pool = None
        self.text = [b"" if kind in (UNKNOWN, CONTROL) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, rank, id, ls, rs) of the pieces of several characters; as many rows as the vocabulary has."""
        rows = [(p, self.ranks[p], i, *self.ends(p)) for p, (_, i) in self.table.items() if len(p) > 1]
        return spark.createDataFrame(rows, "piece string, rank int, id int, ls array<int>, rs array<int>")

    def ends(self, piece: str) -> tuple[list[int], list[int]]:
        """The ranks at which its parts at the start are merged on, by their end, and those at its end, by their start; -1: no such part."""
        parts, on = [(k, k + 1) for k in range(len(piece))], {(0, len(piece)): NEVER}
        while len(parts) > 1:
            rank, k = min(((self.ranks.get(piece[x[0] : y[1]], NEVER), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
            if rank == NEVER:
                raise ValueError(f"the piece {piece!r} isn't what its characters merge to")
            if any(x[1] - x[0] > 1 and self.ranks[piece[slice(*x)]] > rank for x in parts[k : k + 2]):
                raise ValueError(f"the piece {piece!r} is of lower rank than its parts")
            on |= dict.fromkeys(parts[k : k + 2], rank)
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
        n = len(piece)
        return [on.get((0, k), -1) for k in range(n + 1)], [on.get((k, n), -1) for k in range(n)]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by a heap of pairs: the best score first, then the leftmost."""
        parts: list[str | None] = list(unit)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (found := self.table.get(parts[i] + parts[j])):
                heapq.heappush(heap, (-found[0], i, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] is None or len(parts[i]) != a or (j := right[i]) >= len(parts) or len(parts[j]) != b:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for p in parts if p is not None for x in ([self.table[p][1]] if p in self.table else [self.bytes[b] for b in p.encode()])]

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """What the ids stand for, one after the other, and the bytes of each."""
        if self._pool is None:
            sizes = np.array([len(t) for t in self.text], np.int64)
            self._pool = np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(sizes) - sizes, sizes
        pool, starts, sizes = self._pool
        return pool[spread(starts[ids], sizes[ids])].tobytes(), sizes[ids]

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes_of(ids)[0].decode(errors="replace").removeprefix(" ")

    def comes_back(self, ids: np.ndarray, sizes: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids of each text decode to it, with spaces for word marks."""
        data, own = self.bytes_of(ids)
        ends = np.append(0, np.cumsum(own))[np.cumsum(sizes)].tolist()
        want = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
        if data == b"".join(want):
            return [a + len(w) == b for a, b, w in zip([0, *ends[:-1]], ends, want, strict=True)]
        return [data[a:b] == w for a, b, w in zip([0, *ends[:-1]], ends, want, strict=True)]


@lru_cache(4)
def loaded(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


def edges(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): pieces of two characters or more in each unit (column unit, distinct)."""
    n = F.coalesce(F.char_length("unit"), F.lit(0))
    # units that are too short go at the end: a filter on them would part this plan from others that read the same exchange
    cut = units.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).alias("start"))
    cut = cut.select("unit", "n", "start", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(longest), F.col("n") - F.col("start"))))).alias("size"))
    cut = cut.where("start + size <= n").select("unit", "start", (F.col("start") + F.col("size")).alias("end"), F.expr("substring(unit, start + 1, size)").alias("piece"))
    # the piece table is as large as the vocabulary, which the model fixes
    found = cut.join(F.broadcast(pieces), "piece").select("unit", F.struct("start", "end", "rank", "id", "ls", "rs").alias("edge"))
    return found.groupBy("unit").agg(F.collect_list("edge").alias("edges"))


EDGE = "struct<start:int,end:int,rank:int,id:int,ls:array<int>,rs:array<int>>"
#: The last edge of the best path to the edge's start: null for a single character.
LAST = "best[e.start - 1]"
#: Whether an edge across the start of e is merged before e and the edge to its left are whole.
JOINED = f"""exists(edges, f -> f.start < e.start and f.end > e.start and f.end <= e.end and f.rank <= e.ls[f.end - e.start]
    and f.start >= coalesce({LAST}.start, e.start - 1) and f.rank < coalesce({LAST}.rs[f.start - {LAST}.start], {NEVER}))"""
#: The last edge of the best path to each position from 1 on.
VITERBI = f"""aggregate(sequence(1, n), cast(array() as array<{EDGE}>), (best, k) ->
    concat(best, array(get(filter(edges, e -> e.end = k and (e.start = 0 or not {JOINED})), 0))))"""
#: The bounds of the best path to the end, from there back.
BACK = "aggregate(sequence(1, n), array(n), (w, i) -> if(w[0] = 0, w, concat(array(coalesce(best[w[0] - 1].start, w[0] - 1)), w)))"


def folded(lattice: DataFrame, single: dict[str, int], byte_ids: list[int]) -> DataFrame:
    """lattice (unit, edges, more) with ids for edges, which may be null.

    single: ids of pieces of one character; other characters that are left alone become bytes. The first CODES code points
    have a table of three bytes each, others are looked for in a list; both are small literals.
    """
    few, many = [(c, i) for c, i in single.items() if ord(c) < CODES], sorted((c, i) for c, i in single.items() if ord(c) >= CODES)
    codes = np.full(CODES, NONE, ">u4")
    codes[[ord(c) for c, _ in few]] = [i for _, i in few]
    three = lambda ids: bytearray(np.array(ids, ">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())
    own = lattice.withColumn("n", F.char_length("unit")).withColumn("edges", F.coalesce("edges", F.expr(f"cast(array() as array<{EDGE}>)")))
    own = own.withColumn("few", F.lit(three(codes))).withColumn("chars", F.lit("".join(c for c, _ in many))).withColumn("many", F.lit(three([i for _, i in many])))
    table = f"array({', '.join(map(str, byte_ids))})"
    raw = f"transform(regexp_extract_all(hex(encode(c, 'utf-8')), '..', 0), h -> {table}[cast(conv(h, 16, 10) as int)])"
    code = lambda table, at: f"cast(conv(hex(substring({table}, 3 * ({at}) + 1, 3)), 16, 10) as int)"
    far = f"transform(array(instr(chars, c)), p -> if(p = 0, {NONE}, {code('many', 'p - 1')}))[0]"
    found = f"if(ascii(c) < {CODES}, {code('few', 'ascii(c)')}, {far})"
    alone = f"transform(array(substring(unit, k, 1)), c -> transform(array({found}), i -> if(i = {NONE}, {raw}, array(i)))[0])[0]"
    # bound names keep Catalyst from moving the folds into the lambdas that read them
    ids = f"flatten(transform(slice(w, 2, size(w) - 1), k -> if(best[k - 1].id is null, {alone}, array(best[k - 1].id))))"
    ids = f"transform(array({VITERBI}), best -> transform(array({BACK}), w -> {ids})[0])[0]"
    return own.withColumn("ids", F.expr(ids)).drop("n", "edges", "few", "chars", "many")


def encoded_units(units: DataFrame, model: Model) -> DataFrame:
    """units (unit, distinct, and more) with ids. A unit without any edge is single pieces and bytes only."""
    lattice = edges(units, model.frame(units.sparkSession), model.longest)
    return folded(units.join(lattice, "unit", "left"), model.single, model.bytes)


def _scanned(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that every row knows its split."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


@lru_cache(1)
def _cutter():
    import regex

    return regex.compile(UNITS).findall


def units_of(text: str) -> list[str]:
    return _cutter()(MARK + text.replace(" ", MARK)) if text else []


def units_of_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of words that stand between spaces, some words' after others'; the place of each word, and how many units the word at each place has."""
    simple = pc.match_substring_regex(words, f"^([{LETTERS}]+[{SIGNS}]*|[{SIGNS}]+)$")
    marked = lambda some: pc.binary_join_element_wise(MARK, some, "")
    parts = pc.split_pattern(marked(pc.replace_substring_regex(words.filter(simple), f"^([{LETTERS}]+)([{SIGNS}]+)$", r"\1 \2")), " ")
    other = pa.array(_cutter()("".join(marked(words.filter(pc.invert(simple))).to_pylist())), pa.string())
    heads = np.flatnonzero(pc.starts_with(other, MARK).to_numpy(zero_copy_only=False))
    sizes = np.append(pc.list_value_length(parts).to_numpy(zero_copy_only=False), np.diff(np.append(heads, len(other)))).astype(np.int64)
    is_simple = simple.to_numpy(zero_copy_only=False)
    place = np.empty(len(words), np.int64)
    place[is_simple], place[~is_simple] = np.arange(len(parts)), np.arange(len(parts), len(words))
    return pa.concat_arrays([parts.flatten(), other]), place, sizes


def plain(texts: pa.Array) -> pa.Array:
    """Whether cutting at spaces cuts between units."""
    odd = [pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")]
    return pc.invert(reduce(pc.or_, odd))


def runs(splits: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(split, first row, row after the last) of rows that follow each other."""
    own = splits.to_numpy()
    at = np.append(0, np.flatnonzero(np.diff(own)) + 1) if len(own) else []
    return zip(own[at].tolist(), at, [*at[1:], len(own)], strict=True) if len(own) else iter(())


def stretches(size: int, texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about so many bytes of text, at least one row each."""
    after = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + size, "right")))
        yield texts[at:stop]
        at = stop


def _pairs(docs: DataFrame, split: Column, long: int) -> DataFrame:
    """(split, unit): the distinct units of each split; all rows of a split are read by one task, one after the other."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        words: list[pa.Array] = []
        units: list[pa.Array] = []

        def cut_words() -> None:
            own = pa.concat_arrays(words).unique() if words else []
            words.clear()
            for k in range(0, len(own), 20_000):  # words of plain texts: cutting many at once cuts each alike
                units.append(units_of_words(own[k : k + 20_000])[0].unique())
            if sum(map(len, units)) > WORDS:
                units[:] = [pa.concat_arrays(units).unique()]

        def found() -> Iterator[pa.RecordBatch]:
            cut_words()
            own = pa.concat_arrays(units).unique() if units else pa.array([], pa.string())
            units.clear()
            own = own.filter(pc.less_equal(pc.utf8_length(own), long))
            for k in range(0, len(own), 50_000):
                part = own[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(part), pa.int64()), part], ["split", "unit"])

        for part in parts:
            for where, first, stop in runs(part.column(0)):
                if where != at:
                    yield from found()
                    at = where
                for own in stretches(TEXT, pc.fill_null(part.column(1)[first:stop], "")):
                    easy = plain(own)
                    words.append(pc.split_pattern(own.filter(easy), " ").flatten().unique())
                    units += [pa.array(units_of(t), pa.string()).unique() for t in own.filter(pc.invert(easy)).to_pylist()]
                    if sum(map(len, words)) + sum(map(len, units[1:])) > WORDS:
                        cut_words()
        yield from found()
        release()

    return docs.select(split.alias("split"), "text").mapInArrow(cut, "split bigint, unit string")


def _units(docs: DataFrame, split: Column, long: int = LONG) -> DataFrame:
    """(unit, splits): distinct units and the splits that have them.

    Where this is joined with what comes of it, both sides read one exchange by unit: the filters keep their columns and
    conditions the same.
    """
    parts = FINER * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = _pairs(docs, split, long).where("unit is not null").repartition(parts, "unit")
    return pairs.groupBy("unit").agg(F.collect_list("split").alias("splits")).where(F.size("splits") > 0)


def encoded(docs: DataFrame, path: str, name: str = "pieces", ids: bool = True, checks: bool = False, long: int = LONG) -> DataFrame:
    """docs with a struct of n_pieces, and on demand ids, their crc32 (as little-endian 32-bit integers) and round_trip.

    round_trip: whether the ids decode to the text, where a word mark in the text itself comes back as a space.
    """
    from pyspark.sql.functions import arrow_udf

    refuse(docs, name)
    docs = docs if _scanned(docs) else staged(docs, "texts")
    spark = docs.sparkSession
    model = loaded(path)
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    tables = scratch(spark, "units")
    found = encoded_units(_units(docs, split, long), model).select("unit", "ids", F.explode("splits").alias("split"))
    with small_batches(spark):
        found.repartition(F.col("split")).write.partitionBy("split").parquet(tables)
    held = spark.sparkContext.broadcast(model)
    kinds = {"n_pieces": ("bigint", pa.int64())}
    if ids:
        kinds["ids"] = ("array<int>", pa.list_(pa.int32()))
    if checks:
        kinds |= {"crc32": ("bigint", pa.int64()), "round_trip": ("boolean", pa.bool_())}

    @arrow_udf(f"struct<{','.join(f'{k}:{v}' for k, (v, _) in kinds.items())}>")
    def made(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        at, lookup = None, None
        for texts, splits in parts:
            out: dict[str, list] = {k: [] for k in kinds}
            for where, first, stop in runs(splits):
                if where != at:
                    at, lookup = where, Lookup(held.value, tables, where, long)
                for own in stretches(LOOKED, pc.fill_null(texts[first:stop], "")):
                    found, sizes = lookup.encode(own)
                    out["n_pieces"].append(sizes)
                    if ids:
                        out["ids"].append(found)
                    if checks:
                        after = np.cumsum(sizes)
                        out["crc32"] += [zlib.crc32(found[a:b]) for a, b in zip((after - sizes).tolist(), after.tolist(), strict=True)]
                        row = at_id = 0
                        for some in stretches(TEXT, own):  # decoding takes many times a text's size
                            rows = slice(row, row + len(some))
                            end = int(after[rows.stop - 1])
                            out["round_trip"] += held.value.comes_back(found[at_id:end], sizes[rows], some.to_pylist())
                            row, at_id = rows.stop, end
            sizes = np.concatenate([np.zeros(0, np.int64), *out["n_pieces"]])
            none = pc.is_null(texts)
            gaps = none.to_numpy(zero_copy_only=False)
            arrays = [pa.array(sizes, pa.int64(), mask=gaps)]
            if ids:
                values = np.concatenate([np.zeros(0, "<i4"), *out["ids"]])
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int32()), mask=none))
            if checks:
                arrays += [pa.array(np.array(out["crc32"], np.int64), mask=gaps), pa.array(np.array(out["round_trip"], bool), mask=gaps)]
            out.clear()
            release()
            yield pa.StructArray.from_arrays(arrays, list(kinds))

    return docs.withColumn(name, made(F.col("text"), split))


class Lookup:
    """Ids of the units of one split, and of the words met in it."""

    def __init__(self, model: Model, tables: str, split: int, long: int = LONG) -> None:
        self.model, self.long = model, long
        self.units, self.ids, self.sizes = table_of(tables, split)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, units: pa.Array) -> np.ndarray:
        """Rows of units in the table; those that are too long for the lattice are merged now and added."""
        place = pc.index_in(units, value_set=self.units)
        if place.null_count:
            new = units.filter(pc.is_null(place)).unique()
            if pc.any(pc.less_equal(pc.utf8_length(new), self.long)).as_py():
                raise RuntimeError("the files were cut into other splits before: encode them again with the session as it is now")
            own = [np.array(self.model.merge(u), "<i4") for u in new.to_pylist()]
            sizes = np.array([len(x) for x in own], np.int64)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes, self.ids = np.append(self.sizes, sizes), np.concatenate([self.ids, *own])
            self.units = pa.concat_arrays([self.units, new])
            place = pc.index_in(units, value_set=self.units)
        return place.to_numpy()

    def of_units(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows of the table, and how many each has."""
        sizes = self.sizes[place]
        return self.ids[spread(self.starts[place], sizes)], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and how many each has."""
        easy = plain(texts)
        coded = pc.split_pattern(texts.filter(easy), " ")
        words = coded.flatten().dictionary_encode()
        units, order, n_units = units_of_words(words.dictionary)
        ids, sizes = self.of_units(self.places(units))
        word_sizes = np.add.reduceat(sizes, np.cumsum(n_units) - n_units) if len(n_units) else np.zeros(0, np.int64)
        index = order[words.indices.to_numpy()]
        own = word_sizes[index]
        easy_ids = ids[spread((np.cumsum(word_sizes) - word_sizes)[index], own)]
        after = np.append(0, np.cumsum(own))
        easy_sizes = np.diff(after[coded.offsets.to_numpy() - coded.offsets[0].as_py()])
        if len(easy_sizes) == len(texts):
            return easy_ids, easy_sizes
        hard = [self.of_units(self.places(pa.array(units_of(t), pa.string())))[0] for t in texts.filter(pc.invert(easy)).to_pylist()]
        is_easy = easy.to_numpy(zero_copy_only=False)
        sizes = np.empty(len(texts), np.int64)
        sizes[is_easy], sizes[~is_easy] = easy_sizes, [len(x) for x in hard]
        starts = np.empty(len(texts), np.int64)
        starts[is_easy] = np.cumsum(easy_sizes) - easy_sizes
        starts[~is_easy] = len(easy_ids) + np.cumsum(sizes[~is_easy]) - sizes[~is_easy]
        return np.concatenate([easy_ids, *hard])[spread(starts, sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the parts that begin at starts, one after the other."""
    after = np.cumsum(sizes)
    out = np.repeat(starts - (after - sizes), sizes)
    out += np.arange(len(out))
    return out


def table_of(tables: str, split: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of one split, all their ids, and how many each has."""
    import pyarrow.parquet as pq
    from pyarrow import fs as kinds

    fs, folder = file_system(tables)
    parts = [pa.table({"unit": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int32()))})]
    for info in fs.get_file_info(kinds.FileSelector(f"{folder}/split={split}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                parts.append(pq.ParquetFile(file).read(["unit", "ids"]).cast(parts[0].schema))
    whole = pa.concat_tables(parts).combine_chunks()
    units, ids = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns)
    return units, ids.flatten().to_numpy(zero_copy_only=False).astype("<i4"), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """rows with the text of column ids."""
    from pyspark.sql.functions import arrow_udf

    refuse(rows, name)
    held = rows.sparkSession.sparkContext.broadcast(loaded(path))

    @arrow_udf("string")
    def made(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if not x.is_valid else held.value.decode(x.values.to_numpy()) for x in part], pa.string())

    return rows.withColumn(name, made(ids))

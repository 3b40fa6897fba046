"""Token ids in shards that are compressed by a pair grammar (Re-Pair) and decode at random access.

Each shard's ids are compressed on their own, until no pair of neighbouring symbols occurs twice without overlap. A round
takes all pairs that occur at least twice and at least 1/512 as often as the most frequent one; where two of them overlap,
the more frequent is replaced, and of one pair's own overlaps every second from the left. Each pair that is replaced twice
or more becomes a nonterminal. The most frequent pair always does, so each round gets on. A pair never crosses the end of a
document. The file holds the rules, the length that each expands to, the compressed symbols, both at as many bits as the
largest needs, and for each document its first symbol and first id, so a document or a range of ids is read (``opened``) and
decoded without the others.

Texts are encoded some megabytes at a time, by distinct words, split at ASCII white space, which the tokenizer's own
splitting never crosses. Words of plain letters and signs go to the tokenizer's model directly, others to the whole of it.
Documents are in ascending doc_id order across and within shards (a null id first; equal ids by their text).

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole, and is never cut between
shards; repeated rows are kept; of pairs that are equally frequent any goes first, the same at every run; an empty table
makes no shard. Only doc_id and text are read, so other columns can't clash. A shard is written under a fresh name by
each attempt of a task and counts only by its row in the committed manifest.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import file_system, release, scratch, small_batches, staged

END = 2
MAGIC = b"RPAIR1\r\n"
#: Ids of a shard, and what part of the greatest count a pair's must be to be replaced in the same round.
SHARD, SHARE = 1 << 21, 512
#: Rules of up to so many ids are held expanded by a reader.
LONG = 64
#: Ranges of ids, and tasks of a reader, at most: the driver draws their bounds from a sample of each.
RANGES = 20_000
#: Bytes of text that are encoded at once.
TEXT = 8 << 20
#: Words of letters whose lower case and composition are the same everywhere, and signs that the tokenizer splits off as one piece.
TAIL = ".,!?;:%&$#*"
#: Words after which a task forgets those it has met.
WORDS = 1 << 20
LETTERS = "a-zß-öø-ÿÀ-ÖØ-Þ"
PLAIN, SIGNS = f"^[{LETTERS}]*[{TAIL}]*$", f"^([{LETTERS}]+)([{TAIL}]+)$"


class Encoder:
    """Ids of whole texts. Each distinct word of an array of texts is encoded once."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would cost memory and time
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a piece that the tokenizer's splitting makes.
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        #: The same model for pieces that are normalised, split and spelt in the byte alphabet already.
        self.bare = Tokenizer.from_str(model)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        alphabet = {b: chr(b) for b in range(256)} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        #: The letters of PLAIN that aren't ASCII, in lower case, in the byte alphabet; none of its signs is such a letter.
        self.spelling = [(chr(c), "".join(alphabet[b] for b in chr(c).encode())) for c in range(0xDF, 0x100) if c != 0xF7]
        self.forget()

    def forget(self) -> None:
        """Words met so far, the first id of each in a list of ids, and how many it has."""
        self.known, self.flat = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has, of words that PLAIN describes: letters, and signs that are split from them."""
        spelt = pc.utf8_lower(pc.replace_substring_regex(words, SIGNS, "\\1 \\2"))
        pieces = np.cumsum(np.sign(lengths_of(words)) + (lengths_of(spelt) > lengths_of(words)))
        at = np.append(np.arange(0, len(words), 512), len(words))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), spelt), " ").to_pylist()
        for k, group in enumerate(groups):
            if not group.isascii():
                for letter, spelling in self.spelling:
                    group = group.replace(letter, spelling)
                groups[k] = group
        found = [np.array(x.ids, "<u4") for x in self.bare.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, "<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)
        if len(ends) - 1 != (pieces[-1] if len(pieces) else 0):
            raise ValueError("the model's pieces don't end where its words do")
        return ids, np.diff(ends[np.append(0, pieces)])

    def learn(self, words: pa.Array) -> None:
        """Add words that aren't known, in their order."""
        plain = pc.match_substring_regex(words, PLAIN)
        ids, sizes = self.plain(words.filter(plain))
        rest = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        sizes = np.append(sizes, [len(x) for x in rest]).astype(np.int64)
        order = np.argsort(np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable"))
        self.known = pa.concat_arrays([self.known, words])
        self.starts = np.append(self.starts, (len(self.flat) + np.cumsum(sizes) - sizes)[order])
        self.sizes, self.flat = np.append(self.sizes, sizes[order]), np.concatenate([self.flat, ids, *rest])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts, and how many each text has."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)  # the tokenizer does so too; only its special tokens, which hold "<|", are told by case
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():
            lower = pc.if_else(special, texts, lower)
        cut = pc.ascii_split_whitespace(lower)
        coded = cut.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        if len(self.known) > WORDS:
            self.forget()
        found = pc.index_in(words, value_set=self.known)
        place = pc.fill_null(found, 0).to_numpy()
        if found.null_count:
            new = pc.is_null(found)
            place = np.where(new.to_numpy(zero_copy_only=False), len(self.known) + np.cumsum(new.to_numpy(zero_copy_only=False)) - 1, place)
            self.learn(words.filter(new))
        place = place[index]
        own = self.sizes[place]
        after = np.cumsum(own)
        ids = self.flat[np.repeat(self.starts[place] - (after - own), own) + np.arange(int(after[-1]) if len(after) else 0)]
        return ids, np.diff(np.append(0, after)[cut.offsets.to_numpy() - cut.offsets[0].as_py()])


@lru_cache(1)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def lengths_of(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def slices(part: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (second column) are about so many bytes together, at least one."""
    after = np.cumsum(lengths_of(part.column(1)), dtype=np.int64)
    at = 0
    while at < len(part):
        before = int(after[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(after, before + size, "right")))
        yield part.slice(at, stop - at)
        at = stop


def compress(ids: np.ndarray, ends: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, rules). ends marks the last symbol of each document; rule k is symbol first + k, first = 1 + the largest id."""
    first = int(ids.max()) + 1 if len(ids) else 1
    # as narrow as can be: most of the time goes into moving these
    symbols, rules, made = ids.astype(np.int32 if first + len(ids) < 1 << 31 else np.int64), [], 0
    # pairs that may occur twice, by their left symbol; a pair that doesn't never will, unless one of its symbols is new
    live = np.ones(len(ids), bool)
    while len(symbols) > 1:
        live &= ~ends
        live[-1] = False
        at = np.flatnonzero(live)
        one, other = symbols[at], symbols[at + 1]
        keys = one.astype(np.int64)
        keys <<= 32
        keys |= other
        ordered = keys
        # of a run of one symbol, every second pair counts
        if len(twin := np.flatnonzero(one == other)):
            run = np.concatenate(([True], np.diff(at[twin]) > 1))
            start = at[twin[run]][np.cumsum(run) - 1]
            ordered = np.delete(keys, twin[(at[twin] - start) % 2 == 1])
        ordered = np.sort(ordered)
        edge = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else at
        counts = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(counts >= 2)
        if not len(often):
            break
        often = often[np.argsort(counts[often], kind="stable")]
        pairs, counts = ordered[edge[often]], counts[often]
        # a pair's place, which is its rank, is looked up by its hash; of pairs that share one, all but the last wait
        bits = np.uint64(64 - max(16, len(pairs).bit_length() + 2))
        slots, own = ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> bits).astype(np.int32) for x in (keys, pairs))
        table = np.zeros(1 << 64 - int(bits), np.int32)
        table[own] = np.arange(len(pairs))
        place = table[slots]
        hit = pairs[place] == keys
        late = own[table[own] != np.arange(len(pairs))]
        if len(late):
            wait = np.zeros(len(table), bool)
            wait[late] = True
            live[at] = hit | wait[slots]
        else:
            live[at] = hit
        # ranks are by count, so those often enough are the last
        hit &= place >= np.searchsorted(counts, -(-int(counts[-1]) // share))
        # by rank along overlapping pairs: every second one down both sides of each peak; where two sides meet, if both have it
        chosen = np.flatnonzero(hit)
        where, rank = at[chosen], place[chosen]
        k = np.arange(len(where), dtype=np.int32)
        beside = where[1:] - where[:-1] == 1
        up = beside & (rank[1:] > rank[:-1])
        left = k - np.maximum.accumulate(np.where(np.concatenate(([True], ~beside | up)), k, np.int32(0)))
        right = np.minimum.accumulate(np.where(np.concatenate((~up, [True])), k, np.int32(len(k)))[::-1])[::-1] - k
        left |= right
        chosen = np.flatnonzero(left & 1 == 0)
        where, rank = where[chosen], rank[chosen]
        good = np.bincount(rank, minlength=len(pairs)) > 1
        chosen = np.flatnonzero(good[rank])
        where, rank = where[chosen], rank[chosen]
        symbols[where] = (first + made - 1 + np.cumsum(good)).astype(symbols.dtype)[rank]
        ends[where] = ends[where + 1]
        live[where] = live[where - 1] = True
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        keep = np.flatnonzero(keep)
        symbols, ends, live = symbols[keep], ends[keep], live[keep]
        rules.append(np.stack([pairs[good] >> 32, pairs[good] & 0xFFFFFFFF], 1))
        made += len(rules[-1])
    return symbols, ends, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule uses only those before it."""
    sizes, at, todo = np.append(1, np.zeros(len(rules), np.int64)), np.maximum(rules - first + 1, 0), np.arange(len(rules))
    while len(todo):
        parts = sizes[at[todo]]
        known = parts.all(1)
        sizes[todo[known] + 1] = parts[known].sum(1)
        todo = todo[~known]
    return sizes[1:]


def split(symbols: np.ndarray, at: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """symbols with the two of its rule instead of each one at some places."""
    times = np.ones(len(symbols), np.int64)
    times[at] = 2
    out = np.repeat(symbols, times)
    left = np.cumsum(times)[at] - 2
    out[left], out[left + 1] = rules[symbols[at] - first].T
    return out


def expand(symbols: np.ndarray, first: int, rules: np.ndarray) -> np.ndarray:
    """The ids of some symbols."""
    while len(at := np.flatnonzero(symbols >= first)):
        symbols = split(symbols, at, first, rules)
    return symbols


def packed(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Parts of a file: the low 16 bits of values, then each further bit that the largest needs."""
    high = max(0, int(values.max()).bit_length() - 16) if len(values) else 0
    return {name: (values & 0xFFFF).astype("<u2")} | {f"{name}_{k}": np.packbits((values >> 16 + k & 1).astype(bool), bitorder="little") for k in range(high)}


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, own: np.ndarray) -> bytes:
    """A shard file of documents that are given by all their ids, end ids included, and how many each has."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(own) - 1] = True
    first = int(ids.max()) + 1
    symbols, ends, rules = compress(ids, ends)
    starts = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    sizes = lengths(first, rules)
    parts = packed("rules", rules.ravel()) | packed("symbols", symbols) | {
        "lengths": sizes.astype(np.min_scalar_type(sizes.max(initial=0)).newbyteorder("<")),
        "doc_ids": np.array([x or 0 for x in doc_ids], "<i8"), "nulls": np.array([x is None for x in doc_ids], np.uint8),
        "first_symbol": starts.astype("<u4"), "first_id": (np.cumsum(own) - own).astype("<u8"),
    }
    head = json.dumps({"first": first, "n_ids": len(ids), "parts": [[k, v.dtype.str, v.size] for k, v in parts.items()]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(v.tobytes() for v in parts.values())


class Ranged:
    """An array in a file that is read by ranges. file: has read_at(bytes, offset)."""

    def __init__(self, file, at: int, kind: str, n: int) -> None:
        self.file, self.at, self.kind, self.n = file, at, np.dtype(kind), n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, where: slice | int) -> np.ndarray:
        start, stop, _ = (slice(where, where + 1) if isinstance(where, int) else where).indices(self.n)
        own = np.frombuffer(self.file.read_at(max(0, stop - start) * self.kind.itemsize, self.at + start * self.kind.itemsize), self.kind)
        return own[0] if isinstance(where, int) else own


class Shard:
    """A shard file: whole documents, and any range of ids of one, are decoded from their own symbols.

    data: the whole file, or a file that is read by ranges (read_at): then the head, the rules and their lengths are read at
    once, and of symbols and the list of documents only what is asked for.
    """

    def __init__(self, data) -> None:
        read = data.read_at if hasattr(data, "read_at") else lambda n, at: data[at : at + n]
        begin = read(12, 0)
        if begin[:8] != MAGIC:
            raise ValueError("not a shard")
        at = 12 + int.from_bytes(begin[8:], "little")
        head = json.loads(read(at - 12, 12))
        self.first, self.n_ids = head["first"], head["n_ids"]
        self.parts = {}
        for name, kind, n in head["parts"]:
            self.parts[name] = Ranged(data, at, kind, n) if hasattr(data, "read_at") else np.frombuffer(data, kind, n, at)
            at += n * np.dtype(kind).itemsize
        for name in ("doc_ids", "nulls", "first_symbol", "first_id"):
            setattr(self, name, self.parts[name])
        self.symbols, self.lengths = self.parts["symbols"], self.parts["lengths"][:]
        #: Ids of a single id and of each rule, and whether they are more than are held expanded.
        self.own = np.append(1, self.lengths)
        self.big = self.own > LONG
        self.rules = self.unpacked("rules", 0, len(self.parts["rules"])).reshape(-1, 2)
        self.flat = self.starts = None

    def hold(self) -> None:
        """Keep what every rule of up to LONG ids expands to, one after the other: for reading many documents."""
        if self.flat is None:
            short = self.lengths <= LONG
            self.flat = expand(self.first + np.flatnonzero(short), self.first, self.rules).astype("<u4")
            own = np.where(short, self.lengths, 0)
            self.starts = np.cumsum(own, dtype=np.int64) - own

    def unpacked(self, name: str, start: int, stop: int) -> np.ndarray:
        """Some values of a packed part."""
        out, k = self.parts[name][start:stop].astype(np.int64), 0
        while (plane := self.parts.get(f"{name}_{k}")) is not None:
            own = np.unpackbits(plane[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: len(out)]
            out |= own.astype(np.int64) << 16 + k
            k += 1
        return out

    def __len__(self) -> int:
        return len(self.doc_ids)

    def symbols_of(self, k: int) -> np.ndarray:
        bounds = [int(x) for x in self.first_symbol[k : k + 2]]
        stop = bounds[1] if len(bounds) > 1 else len(self.symbols)
        return self.unpacked("symbols", bounds[0], stop)

    def sizes_of(self, symbols: np.ndarray) -> np.ndarray:
        return self.own[np.maximum(symbols - (self.first - 1), 0)].astype(np.int64)

    def long(self, symbols: np.ndarray) -> np.ndarray:
        """Places of the symbols that aren't held expanded."""
        return np.flatnonzero(self.big[np.maximum(symbols - (self.first - 1), 0)])

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: long ones are split, then each rule's are copied whole, where they are held."""
        if self.flat is None:
            return expand(symbols, self.first, self.rules).astype("<u4")
        while len(at := self.long(symbols)):
            symbols = split(symbols, at, self.first, self.rules)
        sizes = self.sizes_of(symbols)
        after = np.cumsum(sizes)
        rule = symbols >= self.first
        # single ids stand behind what the rules expand to
        pool = np.concatenate([self.flat, symbols[~rule].astype("<u4")])
        start = np.empty(len(symbols), np.int64)
        start[rule] = self.starts[symbols[rule] - self.first]
        start[~rule] = len(self.flat) + np.arange(len(pool) - len(self.flat))
        return pool[np.repeat(start - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)]

    def document(self, k: int) -> np.ndarray:
        return self.expanded(self.symbols_of(k))

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of document k, from the symbols that hold them alone; long ones are split where they do."""
        own, before = self.symbols_of(k), 0
        while True:
            after = before + np.cumsum(self.sizes_of(own))
            a, b = int(np.searchsorted(after, start, "right")), int(np.searchsorted(after, stop, "left")) + 1
            own, before = own[a:b], int(after[a - 1]) if a else before
            if not len(at := self.long(own)):
                return self.expanded(own)[start - before : stop - before]
            own = split(own, at, self.first, self.rules)

    def all(self, part: int = 1 << 18) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) of each document, about so many ids expanded at a time."""
        self.hold()
        k = 0
        while k < len(self):
            stop = max(k + 1, int(np.searchsorted(self.first_id, int(self.first_id[k]) + part)))
            end = self.first_symbol[stop] if stop < len(self) else len(self.symbols)
            ids = self.expanded(self.unpacked("symbols", int(self.first_symbol[k]), int(end)))
            for j in range(k, stop):
                a = int(self.first_id[j] - self.first_id[k])
                b = int(self.first_id[j + 1] - self.first_id[k]) if j + 1 < len(self) else self.n_ids - int(self.first_id[k])
                yield (None if self.nulls[j] else int(self.doc_ids[j])), int(self.first_id[j]), ids[a:b]
            k = stop


def opened(uri: str, shard: str) -> Shard:
    """A shard of a folder for reading documents by ranges."""
    fs, path = file_system(uri)
    return Shard(fs.open_input_file(f"{path}/{shard}"))


def written(docs: DataFrame, model_path: str, uri: str | None = None, end: int = END, shard: int = SHARD, text_mb: int = 48) -> DataFrame:
    """Write shards of all texts of docs (doc_id, text); the manifest (uri, shard, part, number, n_docs, n_ids, bytes).

    One range shuffle of the texts puts them in order; a task closes a shard whenever it holds ``shard`` ids.
    """
    spark = docs.sparkSession
    folder = uri or scratch(spark, "shards")
    with open(model_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chars = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(RANGES, max(1, -(-chars // (text_mb << 20))))
    ordered = own.repartitionByRange(int(n), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        made = []
        doc_ids, ids, sizes, held = [], [], [], 0

        def close() -> None:
            name, data = f"{uuid.uuid4().hex}.rp", shard_bytes(doc_ids, np.concatenate(ids), np.concatenate(sizes))
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(data)
            made.append({"uri": folder, "shard": name, "part": TaskContext.get().partitionId(), "number": len(made), "n_docs": len(doc_ids), "n_ids": held, "bytes": len(data)})

        for part in parts:
            for own in slices(part, TEXT):
                found, n = encoder(model.value).encode(own.column(1))
                found = np.insert(found, np.cumsum(n), end)
                n = n + 1
                names, after, at, before = own.column(0).to_pylist(), np.cumsum(n), 0, 0
                while at < len(n):  # up to the document that fills the shard
                    stop = min(len(n), int(np.searchsorted(after, before + shard - held)) + 1)
                    doc_ids += names[at:stop]
                    ids.append(found[before : after[stop - 1]])
                    sizes.append(n[at:stop])
                    held += int(after[stop - 1]) - before
                    at, before = stop, int(after[stop - 1])
                    if held >= shard:
                        close()
                        doc_ids, ids, sizes, held = [], [], [], 0
        if doc_ids:
            close()
        doc_ids, ids, sizes = [], [], []
        release()
        kinds = {"uri": pa.string(), "shard": pa.string(), "part": pa.int32(), "number": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64(), "bytes": pa.int64()}
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in kinds.items()], list(kinds))

    with small_batches(spark):
        return staged(ordered.mapInArrow(write, "uri string, shard string, part int, number int, n_docs bigint, n_ids bigint, bytes bigint"), "shards-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    The ids before a shard are summed over the manifest: first within each part, then over the few parts.
    """
    from pyspark.sql import Window

    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("parts_before"))
    shards = manifest.withColumn("own_before", before(Window.partitionBy("part").orderBy("number"))).join(parts, "part")
    shards = shards.select("uri", "shard", (F.col("own_before") + F.col("parts_before")).alias("base"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = file_system(uri)
                with fs.open_input_stream(f"{path}/{name}") as file:
                    held = Shard(file.read())
                rows = [(i, base + at, len(x), zlib.crc32(x)) for i, at, x in held.all()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = min(RANGES, max(1, manifest.count()))
    return shards.repartition(n, "shard").mapInArrow(load, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")

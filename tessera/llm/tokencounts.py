"""Token counts of sections, from one encoding of each whole document.

A document is encoded once. Each token's span of characters comes from the bytes it stands for; tokens and sections are
both in order and do not overlap, so their interval join is a merge. A token belongs to a section by an explicit rule:

* ``start``: the section that holds its first character;
* ``end``: the section that holds its last character;
* ``most``: the section that holds most of its bytes, the first of equals;
* ``split``: every section that it touches, by its share of the token's bytes.

Sections cover the text without gaps: lines with their line end, or given lists of starts. Counts over a document's
sections always add up to its tokens. Defined cases: a null or empty text has one section without tokens; a section
without characters gets no token; tokens inside a character of several bytes belong where the character does; a token
that two sections hold equally belongs to the first by ``most``. Rows that repeat are counted each; an empty table stays
empty; a text of any length is encoded whole. Other columns stay as they are; one of the result's name is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import refuse

RULES = ("start", "end", "most", "split")


@lru_cache(4)
def loaded(path: str, pattern: str):
    """The encoder and the number of bytes of each id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def lines(data: bytes) -> np.ndarray:
    """Where lines start, in bytes; a last line without characters counts only if the text is empty."""
    starts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.concatenate(([0], starts[starts < len(data)]))


def attributed(sizes: np.ndarray, starts: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Tokens of each section. sizes: bytes of each token; starts: first byte of each section, ascending, the first 0."""
    out = np.zeros(len(starts))
    if not len(sizes):
        return out
    after = np.cumsum(sizes)
    begin = after - sizes
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, after - 1, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=len(starts)).astype(float)
    if rule == "end":
        return np.bincount(last, minlength=len(starts)).astype(float)
    out += np.bincount(first[first == last], minlength=len(starts))
    ends = np.append(starts[1:], total)
    for k in np.flatnonzero(first != last).tolist():
        own = np.arange(first[k], last[k] + 1)
        share = np.minimum(ends[own], after[k]) - np.maximum(starts[own], begin[k])
        if rule == "most":
            out[own[np.argmax(share)]] += 1
        else:
            out[own] += share / sizes[k]
    return out


def counted(docs: DataFrame, path: str, pattern: str, rule: str = "start", name: str = "sections", starts: Column | None = None) -> DataFrame:
    """docs with an array of (start, end, n_tokens): character offsets of each section and its tokens.

    starts: ascending character offsets of the sections, the first 0; lines if not given.
    """
    from pyspark.sql.functions import arrow_udf

    refuse(docs, name)
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64())])

    def one(data: bytes, given: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encoder, sizes = loaded(path, pattern)
        head = np.frombuffer(data, np.uint8) & 0xC0 != 0x80  # of characters
        at = np.append(np.flatnonzero(head), len(data))
        begins = lines(data) if given is None else at[np.minimum(np.array(given, np.int64), len(at) - 1)]
        own = sizes[np.array(encoder.encode_ordinary(data.decode()), np.int64)] if data else np.zeros(0, np.int64)
        chars = np.searchsorted(at, begins)
        return chars, np.append(chars[1:], len(at) - 1), attributed(own, begins, len(data), rule)

    def made(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, given in parts:
            out = [one((t or "").encode(), g) for t, g in zip(texts.to_pylist(), given.to_pylist(), strict=True)]
            ends = np.cumsum([0, *(len(x[0]) for x in out)])
            flat = [np.concatenate([np.zeros(0), *(x[k] for x in out)]) for k in range(3)]
            values = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)), pa.array(flat[2])], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    @arrow_udf("array<struct<start:bigint,end:bigint,n_tokens:double>>")
    def sections(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from made(parts)

    return docs.withColumn(name, sections(F.col("text"), F.lit(None).cast("array<int>") if starts is None else starts))

"""Language ID in two steps: the family first, then one-versus-one linear support vector machines within it.

A text is its lower-cased letters, other characters becoming single spaces. Features are the square roots of the counts
of hashed byte 1- to 4-grams of the whole text, scaled to length one. Every machine is linear with a squared hinge loss.

It learns from labelled rows only, at most about ``per_label`` for each language (a sample by a hash of id and text, the
same at every run). Texts of any length are read whole, in learning too. Defined cases: a text that is null or has no
letter is ``und`` with score 0; so is every text if no row has a label. One family or one language alone is taken
without a machine; where machines tie, the language that comes first by its code wins. Rows with null ids are predicted
like others. Repeated rows are predicted each, and learned from once. An empty table gives an empty result. Other columns
stay as they are; one that has a result's name is an error unless a prefix is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import refuse, release, unused

DIMS = 1 << 13
LETTER = re.compile(r"[^\W\d_]")
ASCII = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
#: Language families by ISO 639-1 code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def family(lang: str) -> str:
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Indices and values of the features; None if the text has no letter."""
    if not text or not LETTER.search(text):
        return None
    normal = b" " + b" ".join(text.lower().encode().translate(ASCII).split()) + b" "
    own = np.frombuffer(normal, np.uint8).astype(np.uint32)
    counts = np.zeros(DIMS, np.int64)
    value = np.zeros(len(own), np.uint32)
    for n in range(4):
        if len(own) <= n:
            break
        value = value[: len(own) - n] * np.uint32(257) + own[n:] + np.uint32(n + 1)
        mixed = value * MULTIPLIERS[n]
        counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(DIMS), minlength=DIMS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at]).astype(np.float32)
    return at.astype(np.int32), values / np.linalg.norm(values)


def machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1, squared hinge loss, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(1 / (1 / c + 4))  # rows have length one, and one for the bias
    for k in range(steps):
        margin = 1 - y * (x @ v[:-1] + v[-1])
        slope = np.where(margin > 0, -2 * margin * y * weight, 0).astype(np.float32)
        step = v - rate * (np.append(x.T @ slope, slope.sum()).astype(np.float32) + v / np.float32(c * 100))
        v, w = step + np.float32(k / (k + 3)) * (step - w), step
    return w


class Model:
    """Machines for families (one against the rest) and for the pairs of languages of each family. Rows are used up."""

    def __init__(self, rows: list[np.ndarray], labels: list[str]) -> None:
        self.langs = sorted(set(labels))
        self.families = sorted({family(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family(x) == f] for f in self.families}
        own = np.array(labels)
        kin = np.array([family(x) for x in labels])
        x = np.zeros((len(labels), DIMS), np.float32)
        while rows:  # they are not kept beside the matrix
            at, values = rows.pop()
            x[len(rows), at] = values
        weights = []
        if len(self.families) == 2:
            weights.append(machine(x, np.where(kin == self.families[0], 1, -1).astype(np.float32)))
        elif len(self.families) > 2:
            weights += [machine(x, np.where(kin == f, 1, -1).astype(np.float32)) for f in self.families]
        self.pairs: dict[str, list[tuple[int, int, int]]] = {}
        for f in self.families:
            self.pairs[f] = []
            for a, b in combinations(range(len(self.members[f])), 2):
                mine = (own == self.members[f][a]) | (own == self.members[f][b])
                self.pairs[f].append((a, b, len(weights)))
                weights.append(machine(x[mine], np.where(own[mine] == self.members[f][a], 1, -1).astype(np.float32)))
        self.weights = np.stack(weights, 1) if weights else np.zeros((DIMS + 1, 1), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if self.langs else None
        if found is None:
            return "und", 0.0
        at, values = found
        margins = values @ self.weights[at] + self.weights[-1]
        sure = 1 / (1 + np.exp(-4 * margins.astype(np.float64)))
        n = len(self.families)
        if n == 1:
            k, score = 0, 1.0
        elif n == 2:
            k = int(margins[0] < 0)
            score = float(max(sure[0], 1 - sure[0]))
        else:
            k = int(np.argmax(margins[:n]))
            score = float(sure[k])
        own = self.members[self.families[k]]
        votes, total, least = np.zeros(len(own)), np.zeros(len(own)), np.ones(len(own))
        for a, b, i in self.pairs[self.families[k]]:
            votes[a if margins[i] >= 0 else b] += 1
            total[a] += margins[i]
            total[b] -= margins[i]
            least[a], least[b] = min(least[a], sure[i]), min(least[b], 1 - sure[i])
        best = max(range(len(own)), key=lambda j: (votes[j], total[j], -j))
        return own[best], float(min(1.0, score * least[best]))


def learned(docs: DataFrame, where: Column, per_label: int = 400, languages: int = 1000) -> Model:
    """Learn from the labelled rows that ``where`` holds for.

    per_label bounds the rows of a language, in expectation; more than so many ``languages`` are an error, as the column is
    then no language.
    """
    from pyspark.sql.functions import arrow_udf

    rows = docs.where(F.col("lang").isNotNull() & F.coalesce(where, F.lit(False)))
    place = F.xxhash64(F.lit("sample"), "doc_id", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(place).alias("n")).limit(languages + 1).collect()}
    if not counts:
        return Model([], [])
    if len(counts) > languages:
        raise ValueError(f"more than {languages} values of lang")
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000_000, per_label * 1_000_000_000 // max(1, n)))])
    sample = rows.where(F.pmod(place, F.lit(1_000_000_000)) < F.element_at(shares, F.col("lang")))
    # rows of equal id, text and label have one place: they come in together, and count once
    sample = sample.select("lang", "text").dropDuplicates()

    @arrow_udf("struct<at:binary,value:binary>")
    def sparse(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            out = [(f[0].tobytes(), f[1].tobytes()) if (f := features(x.as_py())) else (None, None) for x in part]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["at", "value"])

    got = sample.select("lang", sparse("text").alias("f")).where("f.at is not null").select("lang", "f.*").collect()
    got.sort(key=lambda r: (r["lang"], r["at"], r["value"]))
    labels = [r["lang"] for r in got]
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in got]
    del got
    model = Model(rows, labels)
    release()
    return model


def identified(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred and score, from the text alone. A table that has one of these names needs a ``prefix`` for them."""
    from pyspark.sql.functions import arrow_udf

    refuse(docs, f"{prefix}lang_pred", f"{prefix}score")

    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            out = [held.value.predict(x.as_py()) for x in part]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["lang", "score"])

    tmp = unused(docs, "lang")
    return docs.withColumn(tmp, predict("text")).withColumn(f"{prefix}lang_pred", F.col(f"`{tmp}`.lang")).withColumn(f"{prefix}score", F.col(f"`{tmp}`.score")).drop(tmp)


def held_out() -> Column:
    """Rows that nothing is learned from: the id's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))

import bisect

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.tokencounts import RULES, attributed, counted, lines

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sections(spark, texts, rule="start", starts=None):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    return [[(s.start, s.end, s.n_tokens) for s in r.sections] for r in counted(df, PATH, public_tokenizers.PATTERN, rule, starts=starts).orderBy("doc_id").collect()]


def test_lines():
    assert lines(b"").tolist() == [0] and lines(b"\n").tolist() == [0] and lines(b"a\n\nb\n").tolist() == [0, 2, 3]


@pytest.mark.parametrize("rule, want", [("start", [2, 1]), ("end", [1, 2]), ("most", [1, 2]), ("split", [1.25, 1.75])])
def test_rules(rule, want):
    assert attributed(np.array([3, 4, 1]), np.array([0, 4]), 8, rule).tolist() == want


def test_a_token_over_three_sections():
    assert attributed(np.array([6]), np.array([0, 1, 5]), 6, "split").tolist() == [1 / 6, 4 / 6, 1 / 6]
    assert attributed(np.array([6]), np.array([0, 1, 5]), 6, "most").tolist() == [0, 1, 0]


def test_random_merges():
    r = np.random.default_rng(1)
    for _ in range(200):
        sizes = r.integers(1, 6, r.integers(1, 30))
        total = int(sizes.sum())
        starts = np.unique(np.append(0, r.integers(0, total, 6)))
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, total)))
        at = np.append(0, np.cumsum(sizes))
        want = {k: np.zeros(len(starts)) for k in RULES}
        for a, b in zip(at, at[1:], strict=False):
            own = owner[a:b]
            want["start"][own[0]] += 1
            want["end"][own[-1]] += 1
            counts = np.bincount(own, minlength=len(starts))
            want["most"][np.argmax(counts)] += 1
            want["split"] += counts / (b - a)
        for k in RULES:
            assert np.allclose(attributed(sizes, starts, total, k), want[k])


def test_defined_cases(spark):
    texts = ["", None, "日本 é\n\n\nab😀c\nd", "\n", "x " * 100_000, "a" * 20_000 + "\nb", " " * 3000 + "x"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for rule in RULES:
        got = sections(spark, texts, rule)
        assert got[0] == got[1] == [(0, 0, 0.0)]
        for t, own in zip(texts, got, strict=True):
            assert [a for a, _, _ in own][1:] == [b for _, b, _ in own][:-1] and own[-1][1] == len(t or "")
            assert abs(sum(n for _, _, n in own) - len(whole.encode(t or "", add_special_tokens=False).ids)) < 1e-6


def test_given_sections(spark):
    got = sections(spark, ["title body text", "é"], starts=F.array(F.lit(0), F.lit(5), F.lit(99)))
    assert got[0] == [(0, 5, 1.0), (5, 15, 2.0), (15, 15, 0.0)] and [x[:2] for x in got[1]] == [(0, 1), (1, 1), (1, 1)]


def test_clashes_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1)], "doc_id long, text string, sections int")
    with pytest.raises(ValueError, match="sections"):
        counted(df, PATH, public_tokenizers.PATTERN)
    got = counted(df, PATH, public_tokenizers.PATTERN, name="own").collect()
    assert [(r.sections, [tuple(x) for x in r.own]) for r in got] == [(1, [(0, 3, 2.0)])] * 2
    assert counted(df.limit(0), PATH, public_tokenizers.PATTERN, name="own").count() == 0


def test_bad_rule(spark):
    with pytest.raises(ValueError):
        sections(spark, ["x"], "none")


def test_query(spark, sf_dir):
    from tessera.llm.queries import QUERIES

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        starts = [0, *(i + 1 for i, c in enumerate(r.text) if c == "\n" and i + 1 < len(r.text))]
        counts = [0] * len(starts)
        for a, _ in whole.encode(r.text, add_special_tokens=False).offsets:
            counts[bisect.bisect_right(starts, a) - 1] += 1
        want += [(r.doc_id, k, a, b, n) for k, (a, b, n) in enumerate(zip(starts, [*starts[1:], len(r.text)], counts, strict=True))]
    assert sorted(tuple(r) for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()) == sorted(want)

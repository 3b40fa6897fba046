import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.repair import Encoder, Shard, compress, expand, lengths, read, shard_bytes, written

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    with open(PATH, encoding="utf-8") as file:
        return Encoder(file.read())


def encoded(words, texts):
    ids, sizes = words.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_give_the_ids_of_whole_texts(whole, words):
    r = random.Random(2)
    chars = list("abcDEFxyz   \n\t.,!?'’&%-_012éÉßİΣñ中\u0958́  \u0085\x1c<|>")
    for _ in range(40):
        texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(30)] + ["It's we'll <|endoftext|>x <|ENDOFTEXT|>", "a" * 3000, "ÀÉÞßÿ... ÷× fin", "Été,été ñ!! Ö", "ÅÅ café́."]
        for t, got in zip([*texts, ""], encoded(words, [*texts, None]), strict=True):
            assert got == whole.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_words_give_the_ids_of_any_text(whole, words, text):
    assert encoded(words, [text])[0] == whole.encode(text, add_special_tokens=False).ids


class Counted:
    """A file that counts what is read."""

    def __init__(self, data):
        self.data, self.count = data, 0

    def read_at(self, n, at):
        self.count += n
        return self.data[at : at + n]


def grammar(n, kinds, seed):
    r = np.random.default_rng(seed)
    return [np.append(r.integers(0, kinds, r.integers(0, n)), 2).astype("<u4") for _ in range(40)]


@pytest.mark.parametrize("kinds", [1, 2, 5, 50, 40_000])
def test_round_trip_and_random_access(kinds):
    docs = grammar(700, kinds, kinds)
    data = shard_bytes(list(range(40)), np.concatenate(docs), np.array([len(d) for d in docs]))
    held = Shard(data)
    assert [x.tolist() for _, _, x in held.all(100)] == [d.tolist() for d in docs] == [x.tolist() for _, _, x in held.all()]
    file = Counted(data)
    ranged = Shard(file)
    grammar_bytes, file.count = file.count, 0
    assert [ranged.document(k).tolist() for k in (0, 20, 39)] == [docs[k].tolist() for k in (0, 20, 39)]
    assert file.count <= 3 * 8 + sum(4 * len(docs[k]) + 8 for k in (0, 20, 39)) and grammar_bytes + file.count < len(data)
    assert len(docs[7]) < 2 or ranged.ids(7, 1, len(docs[7])).tolist() == docs[7][1:].tolist()
    r = random.Random(kinds)
    for k, d in enumerate(docs):
        assert held.document(k).tolist() == d.tolist()
        a, b = sorted((r.randint(0, len(d)), r.randint(0, len(d))))
        assert held.ids(k, a, b).tolist() == d[a:b].tolist() if a < b else True
    if kinds <= 5:
        assert len(held.rules) and len(held.symbols) < held.n_ids / 2


def test_rules_stay_within_documents_and_lengths_are_right():
    flat = np.tile(np.array([5, 6, 2]), 200)
    ends = np.zeros(600, bool)
    ends[2::3] = True
    symbols, marks, rules = compress(flat, ends)
    assert marks.sum() == 200 and marks[-1] and len(symbols) == 200
    assert expand(symbols, 7, rules).tolist() == flat.tolist()
    assert [len(expand(np.array([7 + k]), 7, rules)) for k in range(len(rules))] == lengths(7, rules).tolist()
    same, _, _ = compress(np.full(1001, 9), np.arange(1001) == 1000)
    assert len(same) < 200


def repeated_pairs(symbols, ends):
    """Pairs that occur twice without overlap."""
    seen, last = {}, {}
    for k in np.flatnonzero(~ends[:-1]).tolist():
        pair = int(symbols[k]), int(symbols[k + 1])
        if last.get(pair) != k - 1 or pair[0] != pair[1]:
            seen[pair], last[pair] = seen.get(pair, 0) + 1, k
    return [p for p, n in seen.items() if n > 1]


@pytest.mark.parametrize("kinds", [1, 2, 5, 50, 3000])
def test_no_pair_is_left_twice(kinds):
    docs = grammar(700, kinds, kinds)
    ids = np.concatenate(docs)
    marks = np.zeros(len(ids), bool)
    marks[np.cumsum([len(d) for d in docs]) - 1] = True
    symbols, ends, rules = compress(ids, marks)
    assert not repeated_pairs(symbols, ends)
    assert expand(symbols, int(ids.max()) + 1, rules).tolist() == ids.tolist() and ends.sum() == 40


def test_a_repeated_passage_becomes_one_symbol():
    passage = np.random.default_rng(1).integers(3, 40_000, 1000)
    own = [np.append(passage, 2).astype("<u4")] * 300
    data = shard_bytes(list(range(300)), np.concatenate(own), np.full(300, 1001))
    held = Shard(data)
    assert len(held.symbols) == 300 and held.lengths.max() == 1001 and len(data) < 20_000
    assert all(x.tolist() == own[0].tolist() for _, _, x in held.all(5000))
    for a, b in ((0, 1001), (0, 1), (400, 400), (437, 612), (1000, 1001)):
        assert held.ids(7, a, b).tolist() == own[0][a:b].tolist()


def test_defined_cases(spark, whole):
    rows = [(3, ""), (1, None), (None, "x y"), (3, "It's a <|endoftext|> été 42"), (2, "a " * 50_000), (2, "a " * 50_000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, start string")
    manifest = written(df, PATH, shard=1000)
    got = sorted((tuple(r) for r in read(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 2, 3, 3]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(6)]
    enc = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((i or 0, len(enc(t)), zlib.crc32(enc(t).tobytes())) for i, t in rows)
    assert manifest.count() > 2 and read(written(df.limit(0), PATH)).count() == 0


def test_query(spark, sf_dir, whole):
    from tessera.llm.queries import QUERIES

    want, at = [], 0
    for i, t in sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()):
        own = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    assert sorted(tuple(r) for r in QUERIES["op8_token_ids"](spark, sf_dir).collect()) == want


def test_words_are_looked_up_once_and_keep_their_ids(monkeypatch):
    """Known and new words of all kinds in turn; the words met so far were looked through twice for each array before."""
    from tessera.llm import repair

    with open(PATH, encoding="utf-8") as file:
        own, found, real = Encoder(file.read()), [], repair.pc.index_in
    monkeypatch.setattr(repair.pc, "index_in", lambda *a, **k: found.append(1) or real(*a, **k))
    for texts in (["one two", "x_1 two! ünder"], ["two x_1 three", "", "Ünder 日本 one?"], ["one two"], []):
        ids, sizes = own.encode(pa.array(texts, pa.string()))
        whole = [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in whole for i in x] and sizes.tolist() == [len(x) for x in whole]
    assert len(found) == 4


def test_symbols_near_31_bits():
    top = (1 << 31) - 3
    ids = np.array([top, 7, top, 7, 7, top], "<u4")
    symbols, ends, rules = compress(ids, np.array([False] * 5 + [True]))
    assert len(rules) == 1 and expand(symbols, top + 1, rules).tolist() == ids.tolist()

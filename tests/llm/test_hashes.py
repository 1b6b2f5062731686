"""Span hashes: no structure in the bytes makes two of them meet, and a hash that two pieces share changes no ids."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.llm import jaccard, packing, ppm, texts
from pulsegrid.llm.queries import TOKENIZER


def doubling(n=1024):
    """A word that doubles with a and b swapped, and its swap: a polynomial hash modulo 2**64 gives them one value."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def spans(words):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return data, np.concatenate([[0], ends[:-1]]), ends


def test_hashes_tell_words_apart():
    rng = random.Random(1)
    words = [w[:n] for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 1024) for w in doubling()]
    words += sorted({"".join(rng.choices("abC\x00é", k=rng.randrange(1, 80))) for _ in range(20_000)})
    for fold in (False, True):
        distinct = sorted({w.lower() if fold else w for w in words if not fold or w.isascii()})
        h = texts.span_hashes(*spans(distinct), fold=fold)
        assert len(np.unique(h)) == len(distinct)
    a, b = (texts.span_hashes(*spans(["x" * k + w + "y"]))[0] for k, w in ((0, "Ab" * 40), (0, "aB" * 40)))
    assert a == b


def test_operators_tell_doubling_words_apart(spark):
    a, b = doubling()
    rows = [(1, f"one two three {a} four five"), (2, f"one two three {b} four five"), (3, a), (4, b), (5, f"{a} {a}"), (6, f"{b} {b}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in jaccard.join(df).collect()} == {(i, i) for i, _ in rows}
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    got = {}
    for r in packing.pack(df, TOKENIZER).collect():
        got.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for i, text in rows:
        assert sum((got[i][s] for s in sorted(got[i])), []) == [*t.encode(text, add_special_tokens=False).ids, 0]
    known = {r.doc_id: r.n_known for r in ppm.score(df, F.col("doc_id") == 3).collect()}
    assert known[3] == 2 and known[4] == 1


def test_shared_hash_of_pieces_is_noticed(monkeypatch):
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends, fold: (ends - starts).astype(np.uint64))
    column = pa.array(["one two six ten", None, "two one ten six", "", "é 日本 a"])
    model = packing.Tokens(TOKENIZER)
    assert [model.model.decode(x.tolist()) for x in model.encode(column)] == [t or "" for t in column.to_pylist()]

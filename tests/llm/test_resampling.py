"""Importance resampling against features counted one by one, and CRC-32 against zlib."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import crc, resampling

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600), st.lists(st.tuples(st.integers(0, 600), st.integers(0, 600)), max_size=8))
def test_crc_equals_zlib(data, cuts):
    spans = [tuple(sorted((min(a, len(data)), min(b, len(data))))) for a, b in cuts]
    got = crc.crc32(np.frombuffer(data, np.uint8), *(np.array([s[k] for s in spans], np.int64) for k in (0, 1)))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


def test_crc_of_long_spans(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(400_000), np.uint8)
    starts = np.array([0, 0, 5, 63, 64, 1, 399_000])
    ends = np.array([400_000, 64, 70, 64 + 63, 128, 300_000, 400_000])
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    for folded in (1 << 16, 256):
        monkeypatch.setattr(crc, "FOLDED", folded)
        assert crc.crc32(data, starts, ends).tolist() == want


def plain(docs, target, percent=5, least=20):
    def feats(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    rows = []
    for i, text in docs:
        words, found = feats(text)
        weight = sum(gain(b) for b in found)
        u = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(words) >= least))
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = percent * len(enough) // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(enough)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def corpus():
    rng = random.Random(4)
    words = [f"Word{i}" for i in range(300)] + ["é", "日本", "x" * 90, "Y" * 200, "a1"]
    docs = [(i, rng.choice(["", " ", ". ", "-"]).join(rng.choices(words, k=rng.randrange(60)))) for i in range(500)]
    docs += [(1000, None), (1001, ""), (1002, " ._- "), (None, "a b c " * 20), (1003, "z" * 3_000_000 + " end " * 30)]
    return docs + [(2000, " ".join(words))] * 300 + [(3000 + i, " ".join(words[:50])) for i in range(100)], ["word1 word2 é x", None, "", " ".join(words[:80])]


def test_resample_equals_plain_version(spark):
    docs, target = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank", "3 as row", "4 as weight", "5 as n_words", "6 as part")
    aim = spark.createDataFrame([(t,) for t in target], "text string").selectExpr("*", "1 as bucket", "2 as doc_id")
    got = sorted((tuple(r) for r in resampling.resample(df.repartition(6), aim).collect()), key=str)
    assert got == plain(docs, target)


def test_resample_many_drawn_and_empty(odd, spark):
    docs, target = corpus()
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(df, aim, percent=60, least_words=1).collect()), key=str)
    assert got == plain(docs, target, 60, 1)
    assert resampling.resample(df.limit(0), aim).count() == 0
    assert resampling.resample(odd, aim.limit(0)).count() == odd.count()

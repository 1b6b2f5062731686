"""The pipeline's stages against plain versions, on odd rows and on an empty table."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pulsegrid.session import written
from llm_plain import groups

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Names that operators use for columns of their own.
CLASH = ("row", "use", "finish", "served", "size", "target", "place", "entries", "score", "predicted", "offending", "n_bytes", "removed", "kept",
         "spans", "node", "h", "times", "c", "part", "n", "source_size", "low", "wide", "key", "__order", "__e")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id < 5"))
    names, left = docs.columns, []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == names
        left.append((docs.count(), docs.select("doc_id").distinct().count()))
    assert left[1][0] == left[1][1] < left[0][0]
    assert left[2] == left[1]
    assert docs.where("length(text) <> n_chars").count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == left[3][1]


def test_jaccard_stage_keeps_the_smallest_id_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root = groups([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(r.doc_id for r in cp.one_of_each(spark, docs, SF).collect())
    assert got == sorted(i for i, (_, c) in root.items() if i == c)


def without(texts):
    """What the repeats stage leaves of each text, all strings counted."""
    n = cp.PASSAGE_BYTES
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        upto = 0
        for i in range(len(b) - n + 1):
            if seen[b[i:i + n]] > 1:
                for k in range(max(i, upto), i + n):
                    gone[k] = True
                upto = i + n
        for k in range(len(b)):  # a character of which a byte stays, stays
            if b[k] & 0xC0 != 0x80:
                e = k + 1
                while e < len(b) and b[e] & 0xC0 == 0x80:
                    e += 1
                if not all(gone[k:e]):
                    gone[k:e] = [False] * (e - k)
        s = 0
        while s < len(b):
            e = s
            while e < len(b) and gone[e]:
                e += 1
            if e > s and len(WORD.findall(b[s:e])) < cp.PASSAGE_WORDS:
                gone[s:e] = [False] * (e - s)
            s = max(e, s) + 1
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode())
    return out


def test_repeats_stage_equals_plain_version(spark):
    passage, short, wide = " ".join(f"pa{i}" for i in range(51)), "x" * 300, "é日" * 120 + " w" * 40
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000 + i, t) for i, t in enumerate([f"one {passage} two", f"three{passage}four", f"{short} a", f"b {short}", f"é{wide}z", f"日{wide}", None, "", passage])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in cp.without_repeats(spark, df, SF).collect()}
    want = dict(zip([i for i, _ in rows], without([t for _, t in rows])))
    assert got == want
    assert "pa30" not in got[9000] and got[9002] == f"{short} a"


def test_mixing_stage_takes_what_the_schedule_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "n_chars")
    got = collections.Counter()
    for r in cp.mixed(spark, docs, SF).collect():
        got[r.doc_id] += len(WORD.findall(r.text.encode()))
        assert len(r.text) == r.n_chars
    from pulsegrid.llm.queries import QUERIES
    assert got == collections.Counter({r.doc_id: r.taken for r in QUERIES["op4_mixing"](spark, SF).collect() if r.taken})


@pytest.mark.parametrize("name, stage", cp.STAGES[:-1])
def test_odd_rows_and_clashing_names(odd, spark, name, stage):
    df = written(odd.select("doc_id", "text", "lang", "source", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in CLASH]), "odd")
    out = stage(spark, df, SF)
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[c] == (c if r.doc_id is None else f"{c}-{r.doc_id}") for r in rows for c in CLASH)
    given = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id for r in rows} <= set(given)
    if name in ("toxicity", "jaccard"):
        assert all(r.text == given[r.doc_id] for r in rows)
    if name == "toxicity":
        assert len(rows) == df.count()


def test_empty_table_through_all_stages(odd, spark):
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0).drop("score", "row", "size", "removed", "token"), SF).count() == 0

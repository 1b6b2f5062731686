"""The filter audit against filters applied one after another to each document."""

from __future__ import annotations

import itertools
import random
import re

from pulsegrid.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(docs, labels):
    """All rows of the audit by running every order over every document."""
    def fails(text):
        words = WORD.findall(text)
        return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}

    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    rows = [(s or "", {**fails(t or ""), "E": i is not None and i > firsts[t or ""]}, i in good, i in toxic) for i, t, s in docs]
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        found, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                shapley[f] += len(removed)
                found.append(("".join(order), step, len(left), len(removed), sum(r[1][f] for r in gone),
                              sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
                gone = gone + removed
        out |= {(part, *r, shapley[r[0][r[1] - 1]]) for r in found}
    return out


def corpus():
    rng = random.Random(2)
    bases = ["", " \t", "# a", "A B c", " ".join(f"w{i}" for i in range(250)), "same " * 220, "Ab " * 230, " ".join(f"W{i}|" for i in range(230)), "é日 " * 199 + "é x"]
    docs = [(i, rng.choice(bases) if rng.random() < .7 else f"only {i} " * rng.randint(1, 120), rng.choice(["a", "b", "", None])) for i in range(400)]
    docs += [(None, bases[4], "a"), (None, bases[4], "a"), (None, "null id", None), (7, docs[7][1], "c"), (7, docs[7][1], "c"), (7, "another text", "a"), (500, None, "n")]
    docs += [(-3, "hot copy", "hot")] * 3 + [(600 + i, "hot copy", "hot") for i in range(300)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 900, 2)] + [(8, 0, 0), (8, 1, 1), (None, 1, 1)]
    return docs, labels


def test_audit_equals_filters_one_by_one(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    df = df.selectExpr("*", "1 as mask", "'x' as part", "2 as n", "3 as h", "4 as digest", "5 as words")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as part", "6 as good", "7 as mask")
    got = [tuple(r) for r in audit.audit(df, lab).collect()]
    want = plain(docs, labels)
    assert len(got) == len(want) and set(got) == want


def test_audit_with_a_full_sketch(spark, monkeypatch):
    """Where every slot is crowded all texts are possible repeats, and the counts stay."""
    docs, labels = corpus()
    for name in ("LEAST_SLOTS", "MOST_SLOTS"):
        monkeypatch.setattr(audit, name, 64)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {tuple(r) for r in audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got == plain(docs, labels)


def test_sketch_clears_unique_texts_only(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000).select(F.xxhash64((F.col("id") % 15_000).cast("string")).alias("h"))
    merged = audit.sketch(df, audit.slot_count(20_000))
    flagged = df.where(audit.maybe_repeated(F.col("h"), merged))
    repeated = df.groupBy("h").count().where("count > 1")
    assert repeated.join(flagged.distinct(), "h").count() == 5_000
    assert flagged.distinct().count() < 5_000 + 500


def test_audit_empty(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert audit.audit(odd, labels).count() == 3 * 600

"""Every operator against a plain version on small tables, and on odd rows and empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_plain import groups, low, shingles
from pulsegrid import session
from pulsegrid.llm import jaccard, language, neighbours, ppm, quality, repeats, topk, toxicity
from pulsegrid.llm.common import remainder
from pulsegrid.llm.graph import components
from pulsegrid.llm.hashtable import HashTable
from pulsegrid.llm.mixing import first_words, mix, schedule
from pulsegrid.llm.packing import Tokens, pack
from pulsegrid.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def documents(spark, columns="doc_id, text"):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr(*columns.split(", ")).collect()]


def test_jaccard_equals_all_pairs(spark):
    want = groups(documents(spark))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_jaccard"](spark, SF).collect()}
    assert got == want


def test_jaccard_chain_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, group=4).collect()}
    assert got == groups(rows)


def test_jaccard_odd(odd, spark):
    got = jaccard.join(odd).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 10 and by[5].component_id == 1 and by[2].n_shingles == 0 and by[4].component_id == 4
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.join(odd.limit(0)).count() == 0


def shared_ids():
    """Rows of (id, text) where ids hold unlike texts, one of them a third of all rows, with near copies under other ids."""
    rng = random.Random(11)

    def near(t):
        t = t.split()
        t[rng.randrange(len(t))] = f"y{rng.randrange(10**6)}"
        return " ".join(t)

    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(60)]
    rows = [(0, t) for t in texts[:30]] + [(100 + i, near(t)) for i, t in enumerate(texts)] + [(200 + i // 2, near(t)) for i, t in enumerate(texts)]
    rows += [(0, ""), (0, texts[0]), (205, None), (300, ""), (300, " "), (None, texts[1]), (101, rows[31][1])]
    rng.shuffle(rows)
    return rows


def test_jaccard_ids_with_unlike_texts(spark):
    rows = shared_ids()
    want = groups([r for r in rows if r[0] is not None])
    for part in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(part)
        got = jaccard.join(df, group=4).collect()
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id) for r in got} == {(i, c) for i, (_, c) in want.items()} | {(None, None)}


def test_jaccard_kept_texts_are_grouped_by_their_own_links(spark):
    rows = shared_ids()
    root = groups([(k, t) for k, (i, t) in enumerate(rows) if i is not None and shingles(t)])
    want = collections.Counter((i, t) for i, t in rows if i is not None and not shingles(t))
    for c in {c for _, c in root.values()}:
        want[min((rows[k][0], rows[k][1]) for k in root if root[k][1] == c)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.one_of_each(spark, df, SF).collect()
    assert collections.Counter((r.doc_id, r.text) for r in left if r.doc_id is not None) == want
    assert [r.text for r in left if r.doc_id is None] == [t for i, t in rows if i is None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_hash_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    t = HashTable(4)
    for part in np.array_split(keys, 7):
        t.add(part)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) < 0).sum() > 4900


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    rng, letters = random.Random(5), list("ab é,.!?'\n\t ×  |1") + [" ", "　", "ß", "日", "'s", " "]
    texts = ["", " ", "<|endoftext|> a", "x " * 50] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    got = Tokens(TOKENIZER, most=200)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for b in range(0, len(texts), 500):
        assert [list(x) for x in got.encode(pa.array(texts[b:b + 500]))] == want[b:b + 500]


@pytest.mark.parametrize("most_open", [2048, 3])
def test_packing_round_trip(spark, most_open):
    rows = documents(spark)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = pack(df, TOKENIZER, most_open=most_open).collect()
    ids = {d: [*map(int, x), 0] for (d, _), x in zip(rows, Tokens(TOKENIZER).encode(pa.array([t for _, t in rows])))}
    again, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = np.frombuffer(r.ids, "<u4")
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        again[r.doc_id].append((r.start, part.tolist()))
        windows[r.sequence_id].append((r.offset, r.length))
    for d, parts in again.items():
        assert [i for _, p in sorted(parts) for i in p] == ids[d]
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0] + [len(p) for _, p in sorted(parts)])[:-1])
    assert set(again) == set(ids)
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == list(np.cumsum([0] + [n for _, n in w])[:-1])
        size = sum(n for _, n in w)
        assert size == 1024 or size & (size - 1) == 0


def test_ppm_equals_plain_version(spark):
    rows = documents(spark)[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, count = collections.defaultdict(collections.Counter), collections.Counter()
    symbols = lambda t: [255] * 5 + list(low(t).encode()) + [255]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(WORD.findall(low(t)))
            count["\0"] += 1
            s = symbols(t)
            for j in range(5, len(s)):
                for k in range(6):
                    seen[tuple(s[j - k:j])][s[j]] += 1

    def plain(t):
        s, total = symbols(t), 0.0
        for j in range(5, len(s)):
            out = set()
            for k in range(5, -1, -1):
                c = {x: n for x, n in seen.get(tuple(s[j - k:j]), {}).items() if x not in out}
                if not c:
                    continue
                n, u = sum(c.values()), len(c)
                if s[j] in c:
                    total += math.log10(c[s[j]] / (n + u))
                    break
                total += math.log10(u / (n + u))
                out |= set(c)
            else:
                total -= math.log10(256 - len(out))
        return total

    n, v = sum(count.values()), len(count)
    for most in (1 << 22, 3000):
        for r in ppm.score(df, remainder("doc_id", 7) != 2, most=most).collect():
            words = [*WORD.findall(low(r.text)), "\0"]
            assert r.train_tokens == n and r.n_tokens == len(words) and r.n_known == sum(count[w] > 0 for w in words)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
            assert r.score == pytest.approx(plain(r.text))


def test_ppm_odd(odd):
    got = ppm.score(odd, F.lit(True)).collect()
    assert len(got) == 10 and {r.n_tokens for r in got if not r.text} == {1} and all(r.score < 0 for r in got)
    none = ppm.score(odd.where("doc_id = 8"), F.lit(False)).first()
    assert none.score == pytest.approx(2 * math.log10(1 / 256)) and none.train_tokens == 0
    assert ppm.score(odd.limit(0), F.lit(True)).count() == 0


def test_mixing_shares(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 10 == 9 else f"s{i % 10 // 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = schedule(df).collect()
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        served = sum(e.served for e in r.entries)
        assert served <= 2 * r["size"]
        by[r.source][0] += served
        by[r.source][1] = r.target
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(n - t) <= 1 for n, t in by.values())
    order = [r.finish for r in mix(schedule(df)).collect()]
    assert order == sorted(order)


def test_mixing_odd(odd, spark):
    got = schedule(odd.drop("size")).collect()
    assert len(got) == 10 and {r["size"] for r in got if not r.text or not r.text.strip()} == {0}
    assert schedule(odd.limit(0)).count() == 0
    cut = spark.createDataFrame([(" a  b\tc ", 2), ("a", 1)], "t string, n long").select(first_words("t", "n").alias("x")).collect()
    assert [r.x for r in cut] == [" a  b", "a"]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 0.2, (300, 8)), np.tile(rng.normal(0, 0.2, (1, 8)), (100, 1))]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [0.0] * 7 + [None]), (None, [0.5] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(256 * v.astype(float)).astype(int)
    scores = q @ q.T
    for block in (64, 8192):
        got = topk.search(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=3).orderBy("query_id", "rank").collect()
        for i in range(0, 400, 50):
            s = scores[i].copy()
            s[i] = -10**9
            best = np.lexsort((np.arange(400), -s))[:5]
            assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == i] == [(k + 1, b, s[b]) for k, b in enumerate(best)]
        assert len(got) == 40
    assert topk.search(df.limit(0), df.limit(0), 5).count() == 0


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = df.toPandas()
    v = np.array(t.embedding.tolist(), dtype=float)
    ids = t.vec_id.to_numpy()
    hit = n = 0
    for q, part in QUERIES["op10_neighbours"](spark, SF).toPandas().groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        best = set(ids[np.argsort(-s)[:20]])
        assert list(part["rank"]) == list(range(1, 21)) and np.allclose(part.score, [s[ids == i][0] for i in part.vec_id])
        hit, n = hit + len(best & set(part.vec_id)), n + 20
    assert hit / n >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(60, [0.0, 0.0]), (61, None)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in neighbours.search(same, same.where("vec_id = 1"), 3).orderBy("rank").collect()] == [0, 2, 3]


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(d[p:p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if n[d[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)),
                    hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def test_repeats_equal_plain_version(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "x" * 200, "ab" * 100]
    for i in range(80):
        t = " ".join(word() for _ in range(rng.randint(1, 60)))
        cut = rng.randint(0, len(passage))
        texts.append(t + " " + passage[cut // 3:][:rng.randint(10, 200)] + " " + t[:rng.randint(0, 90)])
    texts += [texts[10], texts[11] + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove(df, length=40, gram=20).orderBy("doc_id").collect()
    mine = [(r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert mine == plain_repeats(texts, 40)
    whole = repeats.remove(df, length=40, gram=20, whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in whole)


def test_repeats_compare_few_strings_and_keep_no_arrays_meanwhile(spark, tmp_path, monkeypatch):
    """Runs that are shared without a repeated string bring no strings to compare, and what is on disk is gone before they are compared."""
    rng = random.Random(10)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = some(24)
    texts = [some(70) + line + some(70) for _ in range(40)]
    strings, there, write = [], [], repeats.written

    def watched(df, label="table"):
        out = write(df, label)
        if label == "strings":
            strings.append(out.selectExpr("coalesce(sum(size(strings)), 0) n").first().n)
            there.extend(p.name for p in tmp_path.rglob("*") if p.name.startswith(("anchors-", "level-")))
        return out

    monkeypatch.setattr(repeats, "written", watched)
    number = itertools.count()
    for module in (repeats, session):
        monkeypatch.setattr(module, "new_path", lambda spark, label: f"{tmp_path}/pulsegrid/{label}-{next(number)}")

    def removed(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
                for r in repeats.remove(df, length=40, gram=20).orderBy("doc_id").collect()]

    assert removed(texts) == plain_repeats(texts, 40)
    assert strings == [0] and there == []
    texts += [t[:100] + some(30) for t in texts] + [some(50) + t[20:] for t in texts[:9]]
    assert removed(texts) == plain_repeats(texts, 40)
    assert strings[1] > 0


@pytest.mark.parametrize("length, gram", [(10, 4), (16, 16), (33, 5)])
def test_repeats_of_other_lengths_equal_plain_version(spark, length, gram):
    rng = random.Random(length)
    some = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    passages = [some(60) for _ in range(3)]
    texts = [None, "", "a" * 50]
    for _ in range(60):
        cut = rng.randint(0, 40)
        texts.append(some(rng.randint(0, 40)) + rng.choice(passages)[cut:cut + rng.randint(0, 50)] + some(rng.randint(0, 40)))
    texts += [texts[9], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repeats.remove(df, length=length, gram=gram).orderBy("doc_id").collect()
    assert [(r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest())
            for r in got] == plain_repeats(texts, length)


def test_repeats_family_takes_batches_one_by_one(spark, tmp_path):
    """Seven batches, the family opened anew for each, give what one call gives; no array but those in use stays."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(6)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 120))) + rng.choice(passages)[rng.randint(0, 60):] for _ in range(70)]
    texts += [None, "", passages[0], passages[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    folder = str(tmp_path / "family")
    hits = []
    for b in range(7):
        family = repeats.Family(spark, folder, b, length=40, gram=20)
        hits.append(family.add(rows.where(f"row % 7 = {b}")).count())
    assert [r for r, _ in family._levels()] == [2, 1, 0] and sum(hits[3:]) > 0
    assert sorted(p.name for p in (tmp_path / "family" / "pulsegrid").glob("level-*")) == ["level-0-7", "level-1-6", "level-2-4"]
    for part in (tmp_path / "family" / "pulsegrid" / "level-2-4").glob("*.parquet"):
        order = [tuple(r) for r in spark.read.parquet(str(part)).select("run", "stretch").collect()]
        assert order == sorted(order)
    family.add(rows.limit(0))
    got = {r.row: r.spans for r in family.spans(rows).collect()}
    for (n_bytes, n_gone, _, _), (i, _) in zip(plain_repeats(texts, 40), enumerate(texts)):
        gone = {p for s in got.get(i, []) for p in range(s.start, s.end)}
        assert len(gone) == n_gone
    once = {r.row: r.spans for r in repeats.spans(rows, 40, 20, batches=1).collect()}
    cover = lambda d: {k: sorted({p for s in v for p in range(s.start, s.end)}) for k, v in d.items()}
    assert cover(got) == cover(once)
    family.close()
    assert not list((tmp_path / "family" / "pulsegrid").glob("level-*"))


def test_row_wise_operators_on_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (8, 0, 1), (7, 1, None), (99, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(odd.limit(0), model).count() == 0
    assert all(r.score < 0.01 for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect())
    graded = quality.score(odd, quality.fit(odd, labels, F.col("quality"))).collect()
    assert len(graded) == 10 and all(0 <= r.tail <= 1 for r in graded)
    said = {r.doc_id: r for r in language.predict(odd, language.fit(odd)).collect()}
    assert said[2].lang_pred == said[3].lang_pred == said[4].lang_pred == "und" and said[1].lang_pred in ("en", "de", "fr")
    assert language.predict(odd, language.fit(odd.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert pack(odd, TOKENIZER).groupBy("doc_id").count().count() == 9


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice(["tree", "house", "river", "cloud", "stone"]) for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        s = [clean() for _ in range(5)]
        if i % 4 == 0:
            s[rng.randrange(5)] += " grumbleword here"
        rows.append((i, ". ".join(s)))
        labels.append((i, int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), use=F.col("doc_id") < 300)
    for r in toxicity.score(df, model).where("doc_id >= 300").collect():
        assert r.predicted == int(r.doc_id % 4 == 0)
        assert [r.text[s.start:s.end].count("grumbleword") for s in r.offending] == [1] * r.predicted


def test_language_and_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language"](spark, sf).join(docs, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a").first().a
    assert got > 0.95
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = QUERIES["op6_quality"](spark, sf).join(labels, "doc_id").where("held_out").selectExpr("avg(cast(quality = predicted as int)) a").first().a
    assert good > 0.85

"""Archives against plain records: round trips, segments across files, broken framing."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from pulsegrid.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=warc.LEAST_REVISITED):
    """Expected rows of ``archived``, page by page."""
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(body) >= least else None
        refers = first if first is not None and first != page else None
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def odd_pages():
    rng = random.Random(5)
    long = "".join(rng.choice("ab<é日>\r\n\x00") for _ in range(90_000))
    rows = [(1, "http://a/", "x" * 99), (2, "http://a/", "x" * 99), (3, "http://b/", "y" * 100), (4, None, "y" * 100), (5, "http://c/ d\r\n", None),
            (6, "", ""), (9, "u", long), (8, "u", long), (None, "u", long), (None, None, "z" * 200), (None, None, "z" * 200),
            (10, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 9), (11, "u", "0\r\n\r\n" * 40), (3, "http://b/", "y" * 100)]
    return rows + [(100 + i, f"u{i}", "copy " * 40) for i in range(200)] + [(400 + i, f"u{i}", rng.randbytes(rng.randrange(50_000)).hex()) for i in range(30)]


def test_pages_come_back(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as digest", "1 as row", "2 as n", "'r' as record_type").repartition(5)
    got = sorted((tuple(r) for r in warc.archived(df).collect()), key=str)
    assert got == plain(rows)
    assert warc.archived(df.limit(0)).count() == 0


def test_payloads_are_the_bytes_that_went_in(spark, tmp_path):
    rows = odd_pages()
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "w"), segment=1000, archive=100_000)
    found = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(found) == len(rows) and not [r.error for r in found if r.error]
    bodies = {(r.record_id.split(":")[2], bytes(r.payload)) for r in found if r.record_type == "response"}
    kept = plain(rows)
    assert bodies == {(str("" if p is None else p), (h or "").encode()) for p, _, h in rows
                      if any(k[0] == p and k[3] == "response" and k[1] == len((h or "").encode()) for k in kept)}
    assert {bytes(r.payload) for r in found if r.record_type == "revisit"} == {b""}


def _segments(block, name, size, order):
    """Records of a block in segments, in a given order."""
    parts = [block[i:i + size] for i in range(0, len(block), size)]
    out = []
    for k in order:
        fields = {"WARC-Type": "response" if k == 1 else "continuation", "WARC-Record-ID": f"<{name if k == 1 else f'{name}:{k}'}>",
                  "Content-Type": warc.HTTP if k == 1 else None, "WARC-Segment-Number": k, "WARC-Segment-Origin-ID": None if k == 1 else f"<{name}>",
                  "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}
        out.append(warc._record(fields, parts[k - 1]) + b"\r\n\r\n")
    return out


def test_segments_across_files_and_faults(spark, tmp_path):
    body = random.Random(1).randbytes(5000)
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 700)
    n = -(-len(block) // 600)
    whole, order = list(range(1, n + 1)), list(range(n, 0, -1))
    other = warc._record({"WARC-Type": "resource", "WARC-Record-ID": "<plain>", "Content-Type": "text/plain"}, body) + b"\r\n\r\n"
    scattered = _segments(block, "scattered", 600, order)
    missing = _segments(block, "missing", 600, [k for k in whole if k != 3])
    endless = _segments(block, "endless", 600, whole[:-1])
    twice = _segments(block, "twice", 600, [*whole, 2])
    unlike = _segments(block, "unlike", 600, whole) + _segments(b"q" * len(block), "unlike", 600, [2])
    short = [r.replace(b"Total-Length: %d" % len(block), b"Total-Length: 9") for r in _segments(block, "short", 600, whole)]
    broken = [warc._record({"WARC-Type": "response", "WARC-Record-ID": "<broken>", "Content-Type": warc.HTTP}, block.replace(b"2bc\r\n", b"zz\r\n", 1)) + b"\r\n\r\n"]
    files = {"a.warc": b"".join(scattered[::2] + missing + short), "b.warc.gz": b"".join(gzip.compress(r) for r in scattered[1::2] + endless + twice),
             "c.warc": b"".join([other, *unlike, *broken]), "d.warc": other.replace(b"<plain>", b"<cut>")[:-800], "e.warc": b"no archive", "f.warc": b"",
             "g.warc.gz": gzip.compress(other.replace(b"<plain>", b"<gz>"))[:-900]}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    found = {r.record_id: (r.payload and bytes(r.payload), r.error) for r in warc.read(spark, str(tmp_path)).collect() if r.record_id}
    for name in ("scattered", "twice", "plain"):
        assert found[name] == (body, None)
    faults = {"missing": "segment missing", "endless": "segment missing", "unlike": "segment doubled", "short": "segment total length",
              "broken": "chunk size", "cut": "record cut off"}
    assert {k: found[k][1] for k in faults} == faults and not any(found[k][0] for k in faults)
    errors = [r.error for r in warc.read(spark, str(tmp_path)).where("record_id is null").collect()]
    assert "no record" in errors and len(errors) == 2


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunks(size):
    for body in (b"", b"a", b"\r\n" * 50, bytes(range(256)) * 40):
        assert warc.unchunked(warc.chunked(body, size)) == body
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc", b"-1\r\n\r\n", b"3\r\nabc\r\n0\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)

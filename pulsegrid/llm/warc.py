"""Web archives: pages written as WARC records, read back, and records in segments put together again.

A page is a ``response`` record with an HTTP block in chunked framing, cut into segments where it is long, or a
``revisit`` record where another page has the same payload.  Archives are gzip files that Spark writes and reads; a
reader takes the records of each file in one task, decodes whole ones there, and groups segments, which may lie in
different files, by the identifier of the record they continue.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.texts import chunks
from pulsegrid.session import discard, new_path, written

#: Longest block of a record, bytes of a chunk of a body, bytes of archive aimed at, least payload that is revisited.
SEGMENT, CHUNK, ARCHIVE, LEAST_REVISITED = 32 << 10, 4 << 10, 32 << 20, 100

#: Names of the format (fixed values).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_END = "\r\n\r\n"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends after it; fields of None are left out."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for i in range(0, len(body), size):
        piece = body[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The body under chunked framing; chunk extensions and trailers are passed over.  ValueError where the framing is broken."""
    parts, i = [], 0
    while True:
        stop = body.find(b"\r\n", i)
        size = re.fullmatch(rb"([0-9A-Fa-f]+)[ \t]*(;.*)?", body[i:stop], re.S) if stop >= 0 else None
        if not size:
            raise ValueError("chunk size")
        n, i = int(size[1], 16), stop + 2
        if not n:
            break
        if body[i + n:i + n + 2] != b"\r\n":
            raise ValueError("chunk end")
        parts.append(body[i:i + n])
        i += n + 2
    if body[i:i + 2] != b"\r\n" and body.find(b"\r\n\r\n", i) < 0:
        raise ValueError("last chunk")
    return b"".join(parts)


def payload(block: bytes, content_type: str | None) -> bytes:
    """What an HTTP block carries, or the block of another type itself.  ValueError where it is broken."""
    if not (content_type or "").lower().startswith("application/http"):
        return block
    stop = block.find(b"\r\n\r\n")
    if stop < 0:
        raise ValueError("HTTP head")
    head = _fields(block[:stop].split(b"\r\n")[1:])
    body = block[stop + 4:]
    if "chunked" in head.get("transfer-encoding", "").lower():
        return unchunked(body)
    length = head.get("content-length")
    if length is not None and (not length.isdigit() or int(length) > len(body)):
        raise ValueError("HTTP length")
    return body if length is None else body[:int(length)]


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, block, error) of every record of an archive, plain or of any number of gzip members.

    What follows a record that is cut off or is no record can't be told apart and ends the archive with an error.
    """
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                yield {}, b"", "no record"
                return
            lines = []
            while (line := stream.readline()).strip():
                lines.append(line.rstrip(b"\r\n"))
            fields = _fields(lines)
            length = fields.get("content-length", "")
            if not line or not length.isdigit():
                yield fields, b"", "record head"
                return
            block = stream.read(int(length))
            if len(block) < int(length):
                yield fields, block, "record cut off"
                return
            yield fields, block, None
    except (EOFError, OSError) as e:
        yield {}, b"", f"archive: {e}"


def _uri(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _identifier(fields: dict[str, str], name: str) -> str | None:
    value = fields.get(name)
    return None if value is None else value.strip("<>")


def write(pages: DataFrame, path: str, segment: int = SEGMENT, archive: int = ARCHIVE, least: int = LEAST_REVISITED,
          date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as WARC archives under ``path``.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest page_id is a response and the others
    revisit it; rows that repeat that id and payload are responses each.  A null html is an empty payload, a null url has
    no field, a null page_id is nobody's smallest unless all are null, when all are responses.  Other columns are
    ignored; an empty table writes no record.  Segments are at most ``segment`` bytes; a file gets the number of pages
    that makes ``archive`` bytes on average.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.unhex(F.sha2("body", 256)).alias("digest"), F.octet_length("body").alias("n"))
    same = written(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("n")), "payloads")
    size = same.agg(F.sum(F.col("n") * F.col("rows")), F.sum("rows")).first()
    per_file = max(1, int(archive // max(1, (size[0] or 0) / max(1, size[1] or 0) + 512)))
    several = same.where((F.col("rows") > 1) & (F.col("n") >= least)).select("digest", "first")
    several = written(several, "copies")
    told = rows.join(several, "digest", "left").select(
        "page_id", "url", "body", F.hex("digest").alias("digest"),
        F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first")).alias("refers"),
        F.monotonically_increasing_id().alias("row"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            for page, url, html, digest, refers, row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                name = f"urn:page:{'' if page is None else page}:{row}"
                out = list(_page(name, _uri(url), html, digest.lower(), refers, segment, date))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    encoded = told.mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    encoded.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    discard(same, several)


def _page(name: str, url: str | None, html: bytes, digest: str, refers: int | None, segment: int, date: str) -> Iterator[bytes]:
    """The records of one page."""
    about = {"WARC-Record-ID": f"<{name}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": HTTP, "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers is not None:
        yield _record({"WARC-Type": "revisit", **about, "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers}>"}, _HEAD)
        return
    block = _HEAD + chunked(html)
    if len(block) <= segment:
        yield _record({"WARC-Type": "response", **about}, block)
        return
    yield _record({"WARC-Type": "response", **about, "WARC-Segment-Number": 1}, block[:segment])
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}:{k}>", "WARC-Date": date, "WARC-Target-URI": url,
                       "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k,
                       "WARC-Segment-Total-Length": len(block) if k == last else None}, block[(k - 1) * segment:k * segment])


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                     ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])
_RECORD_SQL = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload binary, error string"


def _origin(fields: dict[str, str]) -> str | None:
    """The record that a segment belongs to; None for a record in one piece."""
    if "warc-segment-number" not in fields:
        return None
    return _identifier(fields, "warc-segment-origin-id") or _identifier(fields, "warc-record-id")


def _described(fields: dict[str, str]) -> list[str | None]:
    return [_identifier(fields, "warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"),
            _identifier(fields, "warc-refers-to"), fields.get("warc-payload-digest")]


def _rows(found: Iterator[list], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` bytes of payload."""
    held, size, at = [], 0, schema.get_field_index("payload")
    for row in found:
        held.append(row)
        size += len(row[at] or b"") + 256
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_digest, payload, error) of all records of the archives in ``path``.

    Continuation records are joined to the record they continue.  A record that can't be decoded has a null payload and
    an error: a segment missing, doubled with other bytes or without a first or last one, a total length that is
    not reached, broken chunks or heads, an archive cut off.  A revisit has the payload its own block carries.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(path).select("content")
    pieces = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("content_type", pa.string()), *list(_RECORD)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list]:
            for content in _contents(batches):
                for fields, block, error in records(content):
                    if _origin(fields) is None:
                        error = error or ("segment without origin" if "warc-segment-number" in fields else None)
                        yield [*_described(fields), *_decoded(block, fields, error)]

        yield from _rows(found(), _RECORD)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[list]:
            for content in _contents(batches):
                for fields, block, error in records(content):
                    if (origin := _origin(fields)) is not None:
                        number, total = (int(v) if v.isdigit() else None for v in (
                            fields["warc-segment-number"], fields.get("warc-segment-total-length", "")))
                        yield [origin, number, total, fields.get("content-type"), *_described(fields), block, error]

        yield from _rows(found(), pieces)

    parts = files.mapInArrow(segments, "origin string, number long, total long, content_type string, " + _RECORD_SQL)
    return files.mapInArrow(whole, _RECORD_SQL).unionAll(parts.groupBy("origin").applyInArrow(_reassembled, _RECORD_SQL))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for value in batch.column(0):
            yield value.as_py()


def _decoded(block: bytes, fields: dict[str, str], error: str | None) -> tuple[bytes | None, str | None]:
    if not error and fields.get("warc-type") == "revisit" and block.endswith(b"\r\n\r\n"):
        return b"", None  # the head of a response without its body
    try:
        return (None, error) if error else (payload(block, fields.get("content-type")), None)
    except ValueError as e:
        return None, str(e)


def _reassembled(group: pa.Table) -> pa.Table:
    """The record that the segments of one origin make."""
    found = sorted(group.to_pylist(), key=lambda s: (s["number"] is None, s["number"]))
    once = {s["number"]: s for s in reversed(found)}
    parts = [once[k] for k in range(1, len(once) + 1) if k in once]
    errors = [s["error"] for s in found if s["error"]]
    total = parts[-1]["total"] if parts else None
    if len(parts) < len(once) or total is None:
        errors.append("segment missing")
    if any(s["payload"] != once[s["number"]]["payload"] for s in found):
        errors.append("segment doubled")
    block = b"".join(s["payload"] for s in parts)
    if total is not None and total != len(block):
        errors.append("segment total length")
    head = parts[0] if parts else found[0]
    fields = [head[f.name] for f in _RECORD][:5]
    fields[0] = head["origin"]
    made = [*fields, *_decoded(block, {"content-type": head["content_type"]}, errors[0] if errors else None)]
    return pa.Table.from_batches(_rows(iter([made]), _RECORD))


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all pages, from archives written and read back.

    A revisit gets the payload of the response with the digest it names.  A record that does not decode to the digest in
    its head stops the query.  See ``write`` for nulls, ties and repeated rows.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    page = lambda c: F.regexp_extract(F.col(c), r"^urn:page:(-?\d*)", 1).try_cast("long")
    found = read(spark, path).select(
        page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), "error",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("named"), F.octet_length("payload").cast("long").alias("n"),
        F.sha2("payload", 256).alias("digest"))
    found = written(found, "records")
    discard(spark.read.format("binaryFile").load(path))
    told = ["page_id", "record_type", "refers_to", "named", "error"]
    response = found.where("record_type is null or record_type <> 'revisit'").select(*told, "n", "digest")
    payloads = response.where(F.col("n") >= LEAST_REVISITED).groupBy(F.col("digest").alias("named")).agg(F.min("n").alias("n"))
    revisit = found.where("record_type = 'revisit'").select(*told).join(payloads, "named", "left").select(
        *told, "n", F.when(F.col("n").isNotNull(), F.col("named")).alias("digest"))
    out = response.unionAll(revisit)
    right = F.when(F.col("error").isNull() & (F.col("digest") == F.col("named")), F.col("digest")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("record of page"), "page_id", "error")))
    return out.select("page_id", F.col("n").alias("payload_bytes"), right.alias("payload_digest"), "record_type", "refers_to")

"""WARC archives: writing with revisits, segmentation and chunked framing, and reading back.

Writing and reading go through Spark's text and binaryFile sources, so archives can lie in any
store that Spark reaches. Every record is a gzip member of its own, so a reader can start at any of
them. Equal payloads are stored once: the largest page_id is the response, the others are revisit
records that refer to its record id.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage

#: Block bytes of one record at most; longer responses continue in further records.
SEGMENT_BYTES = 16384
#: Payload bytes of one chunk of the transfer framing.
CHUNK_BYTES = 4096
#: Records of one archive file at most, which bounds what a reader holds.
FILE_RECORDS = 1000
#: Smallest payload that is stored once.
MIN_REVISIT_BYTES = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URI = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits as 32 groups of 5 bits."""
    hexed = F.sha1(payload)
    out = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_id, refers_to and refers_to_id (null for a response).

    Null html is an empty payload. Rows that repeat a page_id with an equal payload are each
    recorded: those with the largest page_id are all responses. Null page_ids rank first.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "row": F.monotonically_increasing_id()})
    each = rows.where(F.octet_length("payload") >= least).groupBy("digest", "page_id").agg(F.max("row").alias("row"), F.count("*").alias("copies"))
    first = stage(each.groupBy("digest").agg(F.max(F.struct("page_id", "copies", "row")).alias("first")), "payloads")
    name = lambda page, more: F.concat(F.lit(URI), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), more)
    numbered = lambda row: F.concat(F.lit(":"), row.cast("string"))
    first_id = F.col("first.page_id")
    revisits = F.coalesce(F.col("page_id") < first_id, F.col("page_id").isNull() & first_id.isNotNull(), F.lit(False))
    alone = F.coalesce(F.col("page_id").eqNullSafe(first_id) & (F.col("first.copies") == 1), F.lit(False))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        name(F.col("page_id"), F.when(alone, "").otherwise(numbered(F.col("row")))).alias("record_id"),
        F.when(revisits, first_id).alias("refers_to"),
        F.when(revisits, name(first_id, F.when(F.col("first.copies") == 1, "").otherwise(numbered(F.col("first.row"))))).alias("refers_to_id"),
    )


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[a : a + size] for a in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def _unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; a ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def _record(kind: str, rid: str, url: str | None, more: list[tuple[str, object]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head += [*more, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block


def _records(rid: str, url, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> Iterator[bytes]:
    told = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
        yield _record("revisit", rid, url, told + more, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk)
    if len(block) <= segment:
        yield _record("response", rid, url, told, block)
        return
    for number, at in enumerate(range(0, len(block), segment), 1):
        more = [("WARC-Segment-Number", number)]
        if number > 1:
            more.append(("WARC-Segment-Origin-ID", f"<{rid}>"))
        if at + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record("response" if number == 1 else "continuation", rid if number == 1 else f"{rid}/{number}", url, (told if number == 1 else []) + more, block[at : at + segment])


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Spark's text writer wants something between its rows: an empty member, which holds nothing.
_BETWEEN = _member(b"").decode("latin-1")


def write_archives(rows: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES, records: int = FILE_RECORDS) -> None:
    """Write with_revisits' rows as WARC files under path, a gzip member per record. Every record ends
    in two line ends."""

    def members(batches):
        for batch in batches:
            out, size = [], 0
            for page in batch.to_pylist():
                for record in _records(page["record_id"], page["url"], page["payload"], page["digest"], page["refers_to_id"], segment, chunk):
                    out.append(_member(record + b"\r\n\r\n"))
                    size += len(out[-1])
                    if size > 1 << 20 or len(out) > 2000:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                        out, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    packed = rows.select("record_id", "url", "payload", "digest", "refers_to_id").mapInArrow(members, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", _BETWEEN).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", records).text(path)


_READ = "record_id string, kind string, url string, digest string, bytes long, refers_to string, origin string, number int, total long, block binary"


def _split(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        at = end + 8 + size
        bare = lambda k: head[k].strip("<>") if k in head else None
        whole = lambda k: int(head[k]) if k in head else None
        yield {
            "record_id": bare("WARC-Record-ID"), "kind": head["WARC-Type"], "url": head.get("WARC-Target-URI"), "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
            "bytes": whole("X-Payload-Length"), "refers_to": bare("WARC-Refers-To"), "origin": bare("WARC-Segment-Origin-ID"), "number": whole("WARC-Segment-Number"), "total": whole("WARC-Segment-Total-Length"), "block": block,
        }


def _inflated(data: bytes) -> bytes:
    """The content of a file of gzip members, or of a plain one. Members are fed in small pieces, as what
    follows a member's end is copied."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = view[at : at + 8192]
            if not len(piece):
                raise ValueError("the last gzip member is cut")
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
    return b"".join(out)


def read_records(spark, path: str) -> DataFrame:
    """All records of the archives under path, segments apart."""
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows = list(_split(_inflated(data)))
                for a in range(0, len(rows), 200):
                    yield pa.RecordBatch.from_pylist(rows[a : a + 200], schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    return files.mapInArrow(parse, _READ)


def reassembled(records: DataFrame) -> DataFrame:
    """Records with whole blocks. Segments are grouped by origin, ordered by number and joined; a gap
    in the numbers or another length than the last segment's total raises an error. Records that
    are not segmented do not move."""
    whole = records.where("number IS NULL")
    parts = records.where("number IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    lead = F.max(F.when(F.col("number") == 1, F.struct("record_id", "kind", "url", "digest", "bytes", "refers_to")))
    joined = parts.groupBy("origin").agg(lead.alias("lead"), F.max("total").alias("total"), F.max("number").alias("n"), F.sort_array(F.collect_list(F.struct("number", F.col("block").cast("string").alias("block")))).alias("parts"))
    block = F.array_join(F.transform("parts", lambda p: p["block"]), "").cast("binary")
    good = (F.octet_length("block") == F.col("total")) & (F.size("parts") == F.col("n")) & F.col("lead").isNotNull()
    joined = joined.withColumn("block", block).withColumn("block", F.when(F.coalesce(good, F.lit(False)), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing or of wrong length: "), F.col("origin"))).cast("binary")))
    return whole.drop("origin", "number", "total").unionByName(joined.select("lead.*", "block"))


def payloads(records: DataFrame) -> DataFrame:
    """record_id, kind, refers_to, payload_bytes, payload_digest, payload of reassembled records.

    A response's payload is decoded from its chunks and its digest verified; a revisit tells the
    full payload's size and digest in its header and has no payload of its own (see `checked`).
    """

    def decode(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size, digest, payload = r["bytes"], r["digest"], None
                if r["kind"] == "response":
                    head, body = r["block"].split(b"\r\n\r\n", 1)
                    payload = _unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if digest not in (None, found):
                        raise ValueError(f"{r['record_id']}: payload does not have its digest")
                    size, digest = len(payload), found
                out.append((r["record_id"], r["kind"], r["refers_to"], size, digest, payload))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))]
            if cols:
                yield pa.RecordBatch.from_arrays(cols, ["record_id", "kind", "refers_to", "payload_bytes", "payload_digest", "payload"])

    schema = "record_id string, kind string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return records.mapInArrow(decode, schema)


def checked(told: DataFrame) -> DataFrame:
    """What payloads tells, less payloads: a revisit whose record is not there as a response, or has
    another length or digest, raises an error."""
    told = stage(told.drop("payload"), "told")
    asked = told.where("kind = 'revisit'").select("refers_to", "payload_bytes", "payload_digest").distinct()
    held = told.where("kind = 'response'").select("record_id", F.col("payload_bytes").alias("held_bytes"), F.col("payload_digest").alias("held_digest"))
    bad = asked.join(held, asked["refers_to"] == held["record_id"], "left").where(F.coalesce((F.col("payload_bytes") != F.col("held_bytes")) | (F.col("payload_digest") != F.col("held_digest")), F.lit(True)))
    if (first := bad.select("refers_to").first()) is not None:
        raise ValueError(f"a revisit does not fit the record {first[0]} that it refers to")
    return told


def op2_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    out = checked(payloads(reassembled(read_records(spark, path))))
    number = lambda c: F.substring_index(F.substring(c, len(URI) + 1, 30), ":", 1)
    return out.select(
        F.when(number("record_id") != "null", number("record_id")).cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").cast("long").alias("refers_to"),
    )


_HEX5 = "CAST('0x' || substr(h, {at}, 5) AS INT)"
_SQL32 = " || ".join(f"substr('{BASE32}', (({_HEX5.format(at=at)} >> {s}) & 31) + 1, 1)" for at in range(1, 41, 5) for s in (15, 10, 5, 0))
OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, {_SQL32} AS payload_digest,
       CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first_id THEN first_id END AS refers_to
FROM d
"""

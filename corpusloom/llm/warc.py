"""WARC archives under Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Records are responses, whose block is an HTTP response with the page as payload, or revisits, whose block is the HTTP
header alone: their payload equals that of the response which WARC-Refers-To names. WARC-Payload-Digest is the
SHA-256 of the full payload in both; the HTTP Content-Length is its full length.

Archives of others are read too: warcinfo, request, metadata and other records come with their whole block as payload
and the digest of it, whatever their ids; a record that isn't valid is refused with its reason, and counted.

Defined results: a null html is an empty payload; payloads under LEAST_BYTES are always responses; rows with equal
page_id and payload are the same page and get the same type; rows with one page_id get one record id, whatever their
payloads; a very long page is a record like others; a null page_id is never the smallest while another is
there; a null url is left out of the record; no pages: no archives. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textvec
from corpusloom.llm.common import filesystem, fresh_dir, materialise, maybe_broadcast, write_whole

LEAST_BYTES = 100
#: Archives are closed at about this size.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DICTIONARY_BYTES = 16 << 10
SAMPLES, SAMPLE_BYTES = 200, 16 << 10
#: Frame and format marks.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
KINDS = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page of one of our own record ids; null for any other."""
    body = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if (name or "").startswith("<urn:page:") and body.removeprefix("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of the samples; none where they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8)
    except zstandard.ZstdError:
        return None


class ArchiveWriter:
    """mapInArrow function: (page_id, url, html, refers_to, revisit) to archives of one task, a row for each."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
        self.folder, self.archive_bytes = folder, archive_bytes

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                pages, urls, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
                for i in range(batch.num_rows):
                    yield record(pages[i].as_py(), urls[i].as_py(), texts[i].as_py() or b"", batch.column(3)[i].as_py(), batch.column(4)[i].as_py())

        source = records()
        first = next(source, None)
        while first is not None:
            uri, count, following = f"{self.folder}/{uuid.uuid4().hex}.warc.zst", 0, None

            def write(out, first=first) -> None:
                nonlocal count, following
                begun, begun_bytes = [first], len(first)
                for x in source:
                    begun.append(x)
                    begun_bytes += len(x)
                    if len(begun) >= SAMPLES or begun_bytes >= SAMPLES * SAMPLE_BYTES:
                        break
                dictionary = train([x[:SAMPLE_BYTES] for x in begun])
                written = 0
                if dictionary:
                    body = zstandard.compress(dictionary.as_bytes(), 19)
                    written += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
                pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True, write_content_size=True)
                for x in begun:
                    written += out.write(pack.compress(x))
                    count += 1
                while written < self.archive_bytes:
                    x = next(source, None)
                    if x is None:
                        return
                    written += out.write(pack.compress(x))
                    count += 1
                following = next(source, None)

            write_whole(uri, write)
            yield pa.record_batch([pa.array([uri]), pa.array([count], pa.int64())], names=["uri", "records"])
            first = following


def write_archives(pages: DataFrame, folder: str) -> list[str]:
    """pages: (page_id, url, html). Writes a record for each row and returns the archives' places.

    Which payloads are repeats is found on digests alone; html is not shuffled unless repeats are too many to broadcast.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("bytes"))
    digests = materialise(rows.filter(F.col("bytes") >= LEAST_BYTES).select("page_id", "digest"), "digests")
    firsts = materialise(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "firsts")
    again = digests.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("at"), F.col("digest").alias("same"), "first").distinct()
    again = maybe_broadcast(materialise(again, "revisits"))
    typed = rows.join(again, F.col("page_id").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("same")), "left")
    out = typed.select("page_id", "url", "html", F.col("first").alias("refers_to"), F.col("first").isNotNull().alias("revisit"))
    return sorted(r["uri"] for r in out.mapInArrow(ArchiveWriter(folder), "uri string, records long").collect())


def _frame_end(buffer: bytes, at: int) -> int | None:
    """Where the frame at ``at`` ends, by its block headers; None if the buffer ends before."""
    try:
        front = bytes(buffer[at : at + 18])
        end = at + zstandard.frame_header_size(front)
        checksum = zstandard.get_frame_parameters(front).has_checksum
    except zstandard.ZstdError:
        if len(buffer) - at >= 18:
            raise
        return None
    while end + 3 <= len(buffer):
        head = int.from_bytes(buffer[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            end += 4 * checksum
            return end if end <= len(buffer) else None
    return None


def frames(stream, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(magic, bytes) of each frame in turn; a truncated or foreign stream raises ValueError."""
    buffer, at, place = b"", 0, 0

    def more() -> bool:
        nonlocal buffer, at, place
        got = stream.read(max(step, len(buffer) - at))
        place += at
        buffer, at = buffer[at:] + got, 0
        return bool(got)

    while True:
        while len(buffer) - at < 8 and more():
            pass
        if at == len(buffer):
            return
        magic = int.from_bytes(buffer[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(buffer[at + 4 : at + 8], "little")
            while end > len(buffer):
                size = end - at
                if not more():
                    raise ValueError(f"skippable frame at {place + at} is cut off")
                end = at + size
        elif magic == FRAME_MAGIC:
            while (end := _frame_end(buffer, at)) is None:
                if not more():
                    raise ValueError(f"frame at {place + at} is cut off")
        else:
            raise ValueError(f"no frame at {place + at}")
        yield magic, buffer[at:end]
        at = end


def _headers(block: bytes, first: bytes, what: str) -> tuple[dict[str, str], bytes]:
    head, found, body = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise ValueError(f"{what} doesn't begin with a {first.decode()} header")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{what} has a header without a colon")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out, body


def parse(data: bytes) -> dict:
    """A record's fields; headers, lengths and digest are validated, ValueError says what is wrong."""
    head, rest = _headers(data, b"WARC/1.", "record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise ValueError(f"record lacks {name}")
    length = int(head["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"record {head['warc-record-id']} has {len(rest) - 4} bytes, its header says {length}")
    kind, block = head["warc-type"], rest[:length]
    if kind not in KINDS:
        raise ValueError(f"record {head['warc-record-id']} is neither a response nor of another known type")
    if kind not in ("response", "revisit") or not head.get("content-type", "").startswith("application/http"):
        return {"id": head["warc-record-id"], "type": kind, "url": head.get("warc-target-uri"), "bytes": len(block), "digest": hashlib.sha256(block).hexdigest(), "refers_to": head.get("warc-refers-to"), "payload": block}
    http, payload = _headers(block, b"HTTP/", "block")
    given = head.get("warc-payload-digest", "")
    size = int(http.get("content-length", len(payload) if kind == "response" and not given.startswith("sha256:") else -1))
    # Digests of other algorithms aren't checked.
    digest = given.removeprefix("sha256:") if given.startswith("sha256:") or kind == "revisit" else hashlib.sha256(payload).hexdigest()
    if kind == "response":
        if size != len(payload):
            raise ValueError(f"record {head['warc-record-id']} has a payload of {len(payload)} bytes, its header says {size}")
        if digest != hashlib.sha256(payload).hexdigest():
            raise ValueError(f"record {head['warc-record-id']} has another digest than its payload")
    elif kind != "revisit" or payload or "warc-refers-to" not in head or size < 0:
        raise ValueError(f"record {head['warc-record-id']} is neither a response nor a valid revisit")
    return {"id": head["warc-record-id"], "type": kind, "url": head.get("warc-target-uri"), "bytes": size, "digest": digest, "refers_to": head.get("warc-refers-to"), "payload": payload}


def raw_records(stream, lenient: bool = False) -> Iterator[bytes | ValueError]:
    """The bytes of an archive's records; the dictionary, if any, is in the leading frame, and each frame is a record.

    A damaged frame, whose checksum or content isn't right, is a ValueError; with lenient it is given in the record's
    place, and the frames after it are read.
    """
    unpack = zstandard.ZstdDecompressor()
    for k, (magic, frame) in enumerate(frames(stream)):
        if magic == DICTIONARY_MAGIC and k == 0:
            body = frame[8:]
            if int.from_bytes(body[:4], "little") == FRAME_MAGIC:
                body = unpack.decompress(body)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == FRAME_MAGIC:
            try:
                size = zstandard.get_frame_parameters(frame[:18]).content_size
                data = unpack.decompress(frame) if size != zstandard.CONTENTSIZE_UNKNOWN else unpack.decompressobj().decompress(frame)
            except zstandard.ZstdError as e:
                if not lenient:
                    raise ValueError(f"damaged frame: {e}") from e
                data = ValueError(f"damaged frame: {e}")
            yield data


def records(stream) -> Iterator[dict]:
    """The records of an archive; one that isn't valid raises ValueError."""
    return map(parse, raw_records(stream))


COLUMNS = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "url": "string", "record_id": "string", "refused": "string"}


@textvec.releasing
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64() if t == "long" else pa.string() for t in COLUMNS.values()]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(COLUMNS))

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = filesystem(uri)
            held: list[tuple] = []
            with fs.open_input_stream(path, compression=None) as stream:
                for data in raw_records(stream, lenient=True):
                    try:
                        if isinstance(data, ValueError):
                            raise data
                        r = parse(data)
                        held.append((page_of(r["id"]), r["bytes"], r["digest"], r["type"], page_of(r["refers_to"]), r["url"], r["id"], None))
                    except ValueError as e:
                        held.append((*[None] * 7, str(e)))
                    if len(held) == 4096:
                        yield rows(held)
                        held = []
            if held:
                yield rows(held)


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """COLUMNS of every record, refused says why one isn't valid, or its frame is damaged; an archive is a task. A stream that isn't whole, or
    isn't of frames, fails."""
    listed = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))
    return listed.mapInArrow(_read, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages as archives in a new folder of the shared one, and read all records back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, fresh_dir(spark, "warc")))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

import hashlib
import io
import struct

import pytest
import zstandard

from corpusloom.llm import warc
from corpusloom.llm.common import filesystem


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, digest string, first long, host string")


def test_types_digests_and_references(spark):
    long = "<p>" + "é" * 120 + "</p>"
    rows = [(1, "http://a/1", long), (5, "http://a/5 x", long), (3, None, long), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "", ""), (None, "u", long), (None, "u", "other " * 40), (9, "u", "<b>" * 200_000), (1, "http://a/1", long)]
    found = warc.archive(pages(spark, rows)).collect()
    expected = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = len(body) >= 100 and html == long and page != 1
        expected.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r)[:5] for r in found], key=key) == sorted(expected, key=key)


def test_archive_layout(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<html><body>{'word ' * 40} {i} {hashlib.sha256(bytes([i % 256])).hexdigest()}</body></html>") for i in range(300)]
    uris = warc.write_archives(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w")
    fs, path = filesystem(uris[0])
    data = fs.open_input_stream(path, compression=None).read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    frames = list(warc.frames(io.BytesIO(data), 1000))
    assert [m for m, _ in frames] == [warc.DICTIONARY_MAGIC] + [warc.FRAME_MAGIC] * 300
    assert b"".join(f for _, f in frames) == data
    assert len(list(warc.records(io.BytesIO(data)))) == 300


def test_archives_are_rotated(spark, tmp_path):
    rows = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 40) for i in range(400)]
    out = pages(spark, rows).coalesce(1).selectExpr("page_id", "url", "html", "cast(null as long) r", "false v")
    made = out.mapInArrow(warc.ArchiveWriter(f"file://{tmp_path}/r", 50_000), "uri string, records long").collect()
    assert len(made) > 1
    assert sum(r["records"] for r in made) == 400
    assert warc.read_archives(spark, [r["uri"] for r in made]).select("page_id").distinct().count() == 400


def _archive(record):
    return zstandard.ZstdCompressor(write_content_size=True).compress(record)


@pytest.mark.parametrize(
    "spoil",
    [
        lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Dote"),
        lambda r: r[:-1],
        lambda r: r.replace(b"payload", b"pay1oad"),
        lambda r: r.replace(b"Content-Length: 11", b"Content-Length: 12"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response2"),
        lambda r: r.replace(b"HTTP/1.1", b"HTTQ/1.1"),
    ],
)
def test_bad_records_are_refused(spoil):
    good = warc.record(1, "u", b"the payload", None, False)
    assert next(warc.records(io.BytesIO(_archive(good))))["payload"] == b"the payload"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(_archive(spoil(good)))))


def test_bad_streams_are_refused():
    frame = _archive(warc.record(1, None, b"", None, False))
    assert list(warc.records(io.BytesIO(b""))) == []
    for data in (frame[:-3], frame + b"more than eight", struct.pack("<II", warc.DICTIONARY_MAGIC, 50) + b"x"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(data)))
    # Frames whose size isn't declared, and skippable ones between, are fine.
    loose = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    body = loose.compress(warc.record(2, None, b"x", None, False)) + loose.flush()
    assert [r["id"] for r in warc.records(io.BytesIO(struct.pack("<II", 0x184D2A50, 3) + b"abc" + frame + body))] == ["<urn:page:1>", "<urn:page:2>"]


def test_archives_of_others_are_read_and_bad_records_counted(spark, tmp_path):
    """warcinfo, request and metadata records, urn:uuid ids, digests of other algorithms, and one record cut short."""

    def other(kind, block, content="application/warc-fields", **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}>", "WARC-Date": "2020-02-02T00:00:00Z", "Content-Type": content, **more, "Content-Length": len(block)}
        return "WARC/1.0\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    made = [other("warcinfo", b"software: x\r\n"), other("request", b"GET / HTTP/1.1\r\n\r\n", "application/http;msgtype=request"), other("response", http, "application/http;msgtype=response", **{"WARC-Payload-Digest": "sha1:ABC", "WARC-Target-URI": "http://x/"}), other("metadata", b""), other("response", http)[:-9], other("nonsense", b"")]
    path = f"{tmp_path}/foreign.warc.zst"
    with open(path, "wb") as f:
        f.write(b"".join(map(_archive, [*made, warc.record(5, "u", b"own", None, False)])))
    found = {r["record_id"]: r for r in warc.read_archives(spark, [f"file://{path}"]).collect() if r["refused"] is None}
    assert sorted(r["record_type"] for r in found.values()) == ["metadata", "request", "response", "response", "warcinfo"]
    assert found["<urn:uuid:response>"]["payload_digest"] == hashlib.sha256(b"<p>x</p>").hexdigest()
    assert found["<urn:uuid:response>"]["url"] == "http://x/" and found["<urn:uuid:response>"]["page_id"] is None
    assert found["<urn:page:5>"]["page_id"] == 5
    assert warc.read_archives(spark, [f"file://{path}"]).filter("refused is not null").count() == 2


def test_damaged_frames_are_refused_and_the_others_read(spark, tmp_path):
    """A wrong checksum, and content that isn't right, in the middle of an archive."""
    pack = zstandard.ZstdCompressor(write_content_size=True, write_checksum=True)
    made = [pack.compress(warc.record(k, "u", f"payload {k} ".encode() * 9, None, False)) for k in range(5)]
    made[1] = made[1][:-1] + bytes([made[1][-1] ^ 1])
    middle = len(made[3]) // 2
    made[3] = made[3][:middle] + bytes(x ^ 255 for x in made[3][middle : middle + 4]) + made[3][middle + 4 :]
    path = f"{tmp_path}/damaged.warc.zst"
    with open(path, "wb") as f:
        f.write(b"".join(made))
    found = warc.read_archives(spark, [f"file://{path}"]).collect()
    assert sorted(r["page_id"] for r in found if r["refused"] is None) == [0, 2, 4]
    assert sum("damaged" in r["refused"] for r in found if r["refused"]) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(made[1])))


def test_no_pages(spark):
    assert warc.archive(pages(spark, [])).count() == 0

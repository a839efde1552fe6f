from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from quirespark.llm import queries, warc

from .. import oracle

KIND = "page_id long, url string, html string, record string, kind int"
ROWS = [(3, "u", "<p>é"), (2, "u2", "<p>é"), (2, "u2", "<p>é"), (None, None, "<p>é"), (5, "x", None), (6, "x\r\ny", ""), (7, "y", "z"), (8, "big", "ab" * 300_000), (9, "big", "ab" * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, tmp_path, least):
    folder = f"file://{tmp_path}/warc"
    manifest, heads = warc.write_archives(pages(spark, ROWS), folder, least)
    got = warc.originals(warc.read_archives(manifest, payloads=True), heads).collect()
    payloads = [(i, (h or "").encode()) for i, _, h in ROWS]
    assert sorted(((r.page_id, bytes(r.payload), r.payload_digest, r.payload_bytes) for r in got), key=repr) == sorted(((i, p, b32(p), len(p)) for i, p in payloads), key=repr)
    by = {}
    for r in got:
        by.setdefault(bytes(r.payload), []).append(r)
    for payload, same in by.items():
        responses = [r for r in same if r.kind == "response"]
        if len(payload) < least:
            assert len(responses) == len(same)
            continue
        least_id = min((r.page_id for r in same if r.page_id is not None), default=None)
        assert len(responses) == 1 and responses[0].page_id == least_id
        assert all(r.of_page == least_id for r in same if r.kind == "revisit")
    archived = {r.record: r for r in warc.read_archives(manifest).collect()}
    assert all(r.kind == archived[r.record].kind and archived[archived[r.record].of_record if r.kind == "revisit" else r.record].kind == "response" for r in got)
    # payload bytes are in the archives once, and originals come back through the join
    raw = b"".join(gzip.decompress((tmp_path / "warc" / f).read_bytes()) for f in os.listdir(tmp_path / "warc"))
    assert raw.count(b"ab" * 300_000) == 1
    for r in got:  # headers as if each record were archived alone, byte for byte
        url = next(u for i, u, h in ROWS if i == r.page_id and (h or "").encode() == bytes(r.payload))
        assert bytes(r.header) == warc.header("response", r.record, r.page_id, url, warc.DATE, hashlib.sha1(bytes(r.payload)).digest(), len(r.payload))
        assert f"Content-Length: {len(r.payload)}\r\n\r\n".encode() in bytes(r.header)
    assert any(b"x%0D%0Ay" in bytes(r.header) for r in got)


def test_dates_of_rows(spark):
    rows = spark.createDataFrame([(1, "u", "a", "2024-05-06T07:08:09Z"), (2, "u", "a", None)], "page_id long, url string, html string, fetched string")
    manifest, heads = warc.write_archives(rows, date=rows["fetched"])
    got = {r.page_id: bytes(r.header).decode() for r in warc.originals(warc.read_archives(manifest), heads).collect()}
    assert "WARC-Date: 2024-05-06T07:08:09Z\r\n" in got[1] and f"WARC-Date: {warc.DATE}\r\n" in got[2]


def test_damage_is_found(spark, tmp_path):
    manifest, _ = warc.write_archives(pages(spark, ROWS[:1]), f"file://{tmp_path}/warc")
    file = tmp_path / "warc" / os.listdir(tmp_path / "warc")[0]
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"<p>", b"<q>")))
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(manifest).collect()


def test_same_as_sql(spark, small):
    name = "op7_content_addressed_warc"
    oracle.same(queries.queries()[name](spark, small), oracle.connect(small), queries.oracle_sql()[name])


def test_empty(spark):
    manifest, heads = warc.write_archives(pages(spark, []))
    assert warc.originals(warc.read_archives(manifest), heads).count() == 0 and heads.count() == 0

"""Content-addressed WARC archives: each payload's bytes once, in a response record; exact headers of all records apart; originals by joins.

Payloads are grouped by SHA-256, which is checked against length and SHA-1 within each group, so that two payloads that differ can't share an
address. The response of a group is the record with the smallest page_id; the others are revisits that name it. Archives are files
of gzip members, one a record, as WARC 1.1 has it. The exact headers of all original records (each a response with its own length) form a table of their own: record, header,
and the record that holds the payload. ``originals`` rebuilds every original record, byte for byte, by a join of that table with what is read from the archives; a revisit's
own header stands in the archive only. The manifest names the files of attempts that succeeded.

Defined results: a null html is an empty payload. Payloads under ``least`` bytes are all responses. A null page_id counts as larger than any other;
repeated rows are records each, of which one is the response. A null url is written as an empty target; line ends in a url are written as %0D and %0A. Other columns are ignored
(but the one that ``date`` names). An empty table gives no archives and an empty result.
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

from .common import filesystem, pieces, shared_dir, written

NAMESPACE = "6f0c9a52-7d3b-4e0e-9d51-2b6f3a1c8e47"
DATE = "2020-01-01T00:00:00Z"
LEVEL = 1  # of compression
READ = 1 << 18


def record_id(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(NAMESPACE), str(record))}>"


def header(kind: str, record: int, page_id: int | None, url: str | None, date: str, sha1: bytes, length: int, of: tuple[int, int | None] | None = None) -> bytes:
    """The exact header of a record. ``of``: for a revisit, record and page_id of the response."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(record)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", f"X-Record: {record}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if of:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(of[0])}", f"X-Refers-To-Record: {of[0]}"]
        if of[1] is not None:
            lines.append(f"X-Refers-To-Page: {of[1]}")
    lines.append(f"Content-Length: {0 if of else length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def hashed(pages: DataFrame, payload: bool, date: str | Column = DATE) -> DataFrame:
    """Row by row: the payload's length and digests, and either its bytes or page_id, url, date and a number of the row (record)."""
    on = F.coalesce(date.cast("string"), F.lit(DATE)) if isinstance(date, Column) else F.lit(date)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), on.alias("date"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    address = F.unhex(F.sha2("payload", 256)).alias("sha256")
    if payload:
        return rows.select("payload", address)
    return rows.select("page_id", "url", "date", F.monotonically_increasing_id().alias("record"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha1("payload")).alias("sha1"), address)


def headers(pages: DataFrame, least: int = 0, date: str | Column = DATE) -> DataFrame:
    """record, kind (response or revisit), of_record, sha256, the record's exact original header, and the header in the archive of those that are revisits: a written table without payloads.

    Only addresses of two records or more are looked up, in a table of their own, so that the join can split an address that most records have.
    """
    rows = written(hashed(pages, False, date), "records")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "record"))
    groups = rows.groupBy("sha256").agg(first.alias("first"), F.count("*").alias("n"), (F.min(F.struct("payload_bytes", "sha1")) == F.max(F.struct("payload_bytes", "sha1"))).alias("same"))
    checked = written(groups.filter("n > 1").filter(F.col("same") | F.raise_error(F.lit("payloads that differ share a SHA-256")).cast("boolean")).select("sha256", "first"), "addresses")
    revisit = (F.col("payload_bytes") >= least) & (F.col("record") != F.col("first.record"))
    told = rows.join(checked, "sha256", "left").select("page_id", "url", "date", "record", "payload_bytes", "sha1", "sha256", F.when(revisit, F.col("first.record")).alias("of_record"), F.when(revisit, F.col("first.page_id")).alias("of_page"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, heads, archived = [], [], []
            for r in batch.select(["page_id", "url", "date", "record", "payload_bytes", "sha1", "of_record", "of_page"]).to_pylist():
                of = None if r["of_record"] is None else (r["of_record"], r["of_page"])
                own = (r["record"], r["page_id"], r["url"], r["date"], r["sha1"], r["payload_bytes"])
                kinds.append("revisit" if of else "response")
                heads.append(header("response", *own))
                archived.append(header("revisit", *own, of) if of else None)
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(kinds, pa.string()), batch.column("of_record"), batch.column("sha256"), pa.array(heads, pa.binary()), pa.array(archived, pa.binary())], names=["record", "kind", "of_record", "sha256", "header", "archived"])

    return written(told.mapInArrow(make, "record long, kind string, of_record long, sha256 binary, header binary, archived binary"), "headers")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str | Column = DATE) -> tuple[DataFrame, DataFrame]:
    """Writes the archives; returns their manifest (file, n_records, n_bytes) and the table of headers. ``date``: when pages were fetched, one for all or a column (as WARC-Date has it)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    heads = headers(pages, least, date)
    store = hashed(pages, True).groupBy("sha256").agg(F.first("payload").alias("payload"))
    full = heads.filter("kind = 'response'").join(store, "sha256").select("header", "payload")
    bare = heads.filter("kind = 'revisit'").select(F.col("archived").alias("header"), F.lit(b"").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, out, n, size = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in (x for b in batches for x in pieces(b, 500)):
            for head, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                size += out.write(gz.compress(head) + gz.compress(payload) + gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return written(full.unionByName(bare).mapInArrow(write, "file string, n_records long, n_bytes long"), "manifest"), heads


def records_of(file: str) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of each record of an archive; one record is held at a time."""
    fs, path = filesystem(file)
    with fs.open_input_stream(path, compression=None) as f:
        rest = b""
        while rest or (rest := f.read(READ)):
            member, parts = zlib.decompressobj(31), []
            while True:
                parts.append(member.decompress(rest))
                rest = member.unused_data
                if member.eof:
                    break
                if not (rest := f.read(READ)):
                    raise EOFError(f"{file} ends inside a record")
            record = b"".join(parts)
            cut = record.index(b"\r\n\r\n") + 4
            length = int(record[:cut].rpartition(b"Content-Length: ")[2])
            if len(record) != cut + length + 4:
                raise ValueError(f"a record of {file} has another length than its header says")
            yield record[:cut], record[cut : cut + length]


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """record, page_id, kind, of_record, of_page, payload_digest, payload_bytes, header (and payload) of each record as it stands in the archives.

    Digest and length of a response are those of the bytes read, which must agree with the header; a revisit has no bytes.
    """
    fields = [("record", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("of_record", pa.int64()), ("of_page", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("header", pa.binary()), *([("payload", pa.binary())] if payloads else [])]
    types = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(fields)
        for file in (f for b in batches for f in b.column(0).to_pylist()):
            rows, size = [], 0
            for head, payload in records_of(file):
                named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)
                number = lambda k: int(named[k]) if k in named else None  # noqa: E731, B023
                row = {"record": number("X-Record"), "page_id": number("X-Page-ID"), "kind": named["WARC-Type"], "of_record": number("X-Refers-To-Record"), "of_page": number("X-Refers-To-Page"), "header": head}
                if row["kind"] == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if f"sha1:{digest}" != named["WARC-Payload-Digest"]:
                        raise ValueError(f"a payload of {file} is not what its digest says")
                    row |= {"payload_digest": digest, "payload_bytes": len(payload)}
                    if payloads:
                        row["payload"] = payload
                rows.append(row)
                size += len(head) + len(payload) * payloads
                if size > READ * 16 or len(rows) == 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(read, ", ".join(f"{n} {types[t]}" for n, t in fields))


def originals(records: DataFrame, heads: DataFrame) -> DataFrame:
    """Every original record from the table of headers and the records read from the archives: record, header, page_id, kind, of_page, payload_digest, payload_bytes (and payload, where the archives were read with payloads).

    The archives' own records say what they are; those that hold a payload give it, by a join, to all that have its address.
    """
    full = [c for c in ("payload_digest", "payload_bytes", "payload") if c in records.columns]
    holds = records.filter("kind = 'response'").select(F.col("record").alias("__of"), *full)
    told = heads.select("record", "header", F.coalesce("of_record", "record").alias("__of")).join(records.select("record", "page_id", "kind", "of_page"), "record")
    return told.join(holds, "__of").select("record", "header", "page_id", "kind", "of_page", *full)

"""Token ids of a corpus as binary files with Elias-Fano document boundaries.

Documents are dealt to files by ranges of doc_id and lie in ascending doc_id order within and between files (nulls first; rows
with one doc_id by their text's key). Each file has two parts: ``<name>.ids``, all ids one after another, little-endian, two
bytes each if the vocabulary allows, else four; and ``<name>.idx``, blocks of BLOCK documents, each with the ends of its documents and their doc_ids, both in Elias-Fano code
(relative to the block's first), and a directory of the blocks at the end. Writers and readers hold one block; no table of 64-bit
offsets is made. Readers select a stretch of boundaries at a time; ``document`` selects those of one document. The manifest, a table, names the files
of the attempts that succeeded, so a lost or repeated task leaves nothing that is read.

Defined results: a null or empty text has the end id alone. Repeated rows are repeated in the files. Other columns are
ignored. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, filesystem, holds, pieces, shared_dir, text_key, written
from .elias_fano import EliasFano
from .tokens import text_ids

MANIFEST = "file string, dtype string, n_docs long, n_ids long, first_null boolean, first_id long, first_key long, first_row long"
#: A block: documents, those without a doc_id (first), ids before it in the file, the least doc_id, bytes of the ends and of the doc_ids.
HEAD = struct.Struct("<IIQqII")
#: The end of an index: what it is, its number of blocks and the documents of each but the last; before it the place of each block.
TAIL = "<4sQI"
#: Documents of a block, boundaries that a reader selects at once, and ids that it holds at once.
BLOCK, SELECT, READ = 1 << 16, 1 << 12, 1 << 20


class Block:
    """The boundaries of up to BLOCK documents."""

    def __init__(self, data: bytes):
        self.count, self.nulls, self.base, self.least, n_ends, n_ids = HEAD.unpack_from(data)
        self.size = HEAD.size + n_ends + n_ids
        self.ends, self.ids = (EliasFano.frombytes(data[a : a + n]) if n else None for a, n in ((HEAD.size, n_ends), (HEAD.size + n_ends, n_ids)))

    @staticmethod
    def tobytes(base: int, doc_ids: list[int | None], ends: list[int]) -> bytes:
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        code = EliasFano.encode(np.array(ends, np.uint64) - np.uint64(base)).tobytes()
        ids = EliasFano.encode(known.view(np.uint64) - known[:1].view(np.uint64)).tobytes() if len(known) else b""
        return HEAD.pack(len(ends), len(ends) - len(known), base, least, len(code), len(ids)) + code + ids

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents first to last - 1 begin in the file, and where the last one ends: one number more than documents."""
        before = self.ends[first - 1] if first else 0
        return np.concatenate([[before], self.ends.values(first, last)]) + self.base

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        known = self.ids.values(max(0, first - self.nulls), max(0, last - self.nulls)) + self.least if self.ids else []
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + [int(x) for x in known]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, files: int | None = None, plain_marks: bool = True) -> DataFrame:
    """Writes the files and returns their manifest. ``files``: about how many; by default as many as shuffle partitions. plain_marks: see ``TextIds``."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens"
    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), text_key().alias("key"), F.monotonically_increasing_id().alias("row"), "text")
    by = [F.asc_nulls_first("doc_id"), F.asc("key"), F.asc("row")]
    dealt = rows.repartitionByRange(*([files] if files else []), *by).sortWithinPartitions(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("text ids", text_ids.cache_clear)
        ids = text_ids(tokenizer, plain_marks)
        fs, path = filesystem(folder)
        name, first, doc_ids, ends, total, n, out, idx, places = f"part-{uuid.uuid4().hex}", None, [], [], 0, 0, None, None, []

        def end_block(base: int) -> None:
            places.append(idx.tell())
            idx.write(Block.tobytes(base, doc_ids, ends))
            doc_ids.clear()
            ends.clear()

        base = 0
        for batch in (x for b in batches for x in pieces(b, 500)):
            if out is None:
                first = [batch.column(i)[0].as_py() for i in range(3)]
                fs.create_dir(path, recursive=True)
                out, idx = fs.open_output_stream(f"{path}/{name}.ids"), fs.open_output_stream(f"{path}/{name}.idx")
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                own = np.append(ids(text), np.array([end_id], ids.dtype))
                out.write(own.tobytes())
                total, n = total + len(own), n + 1
                doc_ids.append(doc_id)
                ends.append(total)
                if len(ends) == BLOCK:
                    end_block(base)
                    base = total
        if out is None:
            return
        if ends:
            end_block(base)
        idx.write(np.array(places, "<u8").tobytes() + struct.pack(TAIL, b"QTI2", len(places), BLOCK))
        out.close()
        idx.close()
        yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "dtype": ids.dtype, "n_docs": n, "n_ids": total, "first_null": first[0] is None, "first_id": first[0], "first_key": first[1], "first_row": first[2]}], schema=SCHEMA)

    return written(dealt.mapInArrow(write, MANIFEST), "manifest")


SCHEMA = pa.schema([("file", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_null", pa.bool_()), ("first_id", pa.int64()), ("first_key", pa.int64()), ("first_row", pa.int64())])


def places_of(f: pa.NativeFile) -> tuple[np.ndarray, int]:
    """Where the blocks of an open index begin and where the last one ends, and the documents of a block."""
    end = f.size() - struct.calcsize(TAIL)
    f.seek(end)
    magic, n, each = struct.unpack(TAIL, f.read(struct.calcsize(TAIL)))
    if magic != b"QTI2":
        raise ValueError("not a token index")
    f.seek(end - 8 * n)
    return np.append(np.frombuffer(f.read(8 * n), "<u8"), end - 8 * n).astype(np.int64), each


def block_at(f: pa.NativeFile, places: np.ndarray, k: int) -> Block:
    f.seek(int(places[k]))
    return Block(f.read(int(places[k + 1] - places[k])))


def document(file: str, dtype: str, i: int) -> tuple[int | None, int, np.ndarray]:
    """(doc_id, start in the file, ids) of the i-th document: its block, two selected boundaries, and its ids are all that is read."""
    fs, path = filesystem(file)
    with fs.open_input_file(f"{path}.idx") as f:
        places, each = places_of(f)
        block, at = block_at(f, places, i // each), i % each
    start, end = block.bounds(at, at + 1).tolist()
    with fs.open_input_file(f"{path}.ids") as f:
        f.seek(start * np.dtype(dtype).itemsize)
        return block.doc_ids(at, at + 1)[0], start, np.frombuffer(f.read((end - start) * np.dtype(dtype).itemsize), dtype)


def documents_of(file: str, dtype: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of every document of a file: a stretch of boundaries is selected at a time, and of their ids a bounded stretch is read."""
    fs, path = filesystem(file)
    width = np.dtype(dtype).itemsize
    with fs.open_input_file(f"{path}.idx") as index, fs.open_input_file(f"{path}.ids") as f:
        places, _ = places_of(index)
        for k in range(len(places) - 1):
            block = block_at(index, places, k)
            for first in range(0, block.count, SELECT):
                last = min(first + SELECT, block.count)
                bounds, doc_ids, at = block.bounds(first, last), block.doc_ids(first, last), 0
                while at < len(doc_ids):
                    start = int(bounds[at])
                    to = max(at + 1, int(np.searchsorted(bounds, start + READ, "right")) - 1)
                    f.seek(start * width)
                    stretch = np.frombuffer(f.read((int(bounds[to]) - start) * width), dtype)
                    for i in range(at, to):
                        yield doc_ids[i], int(bounds[i]), stretch[int(bounds[i]) - start : int(bounds[i + 1]) - start]
                    at = to


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 (of the ids as unsigned 32-bit) from the files."""
    order = W.orderBy(F.desc("first_null"), "first_id", "first_key", "first_row")
    based = manifest.withColumn("base", F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, -1))).select("file", "dtype", F.coalesce("base", F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for row in (r for b in batches for r in b.to_pylist()):
            found = []
            for doc_id, start, ids in documents_of(row["file"], row["dtype"]):
                found.append({"doc_id": doc_id, "start": row["base"] + start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                if len(found) == 10_000:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    spread = based.repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

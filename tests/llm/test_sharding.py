from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm.sharding import jump, sharded


def plain_jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@settings(max_examples=50)
@given(st.lists(st.integers(0, 2**60 - 1), min_size=1, max_size=30), st.integers(1, 200))
def test_jump(keys, n):
    got, more = jump(np.array(keys), n), jump(np.array(keys), n + 1)
    assert got.tolist() == [plain_jump(k, n) for k in keys]
    assert all(a == b or b == n for a, b in zip(got, more))


def test_all_rows_once(spark):
    rows = [(i, f"t{i % 7}é") for i in range(300)] + [(None, None), (None, ""), (5, "t5é"), (5, "t5é")] + [(9, "hot")] * 200
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, slot long")  # clashing names
    got = sharded(docs, 5).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(r.grown_shard in (r.shard, 5) for r in got)
    assert len({r.shard for r in got if r.doc_id == 9}) == 1


def test_empty(spark):
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0

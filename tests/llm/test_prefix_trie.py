from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from quirespark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, chunk long"


def key(role, text) -> str:
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def plain(rows: list[tuple]) -> list[tuple]:
    """All nodes, from whole rebuilt conversations in memory."""
    said: dict = {}
    for c, t, role, text in rows:
        said.setdefault(c, []).append((t is not None, t or 0, key(role, text), role or "", text or ""))
    said = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in said.items()}
    rebuilt = {}
    for c, own in said.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = None if c is None else (abs(c) - abs(c) % 100) * (1 if c > 0 else -1)
        rebuilt[c] = tuple((said[base][:h] if base in said else []) + own[h:])
    order = sorted(rebuilt, key=lambda c: (c is None, c or 0))
    nodes: dict = {}
    for c in order:
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(rebuilt[c][:d], []).append(c)
    children: dict = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += q not in children
            saved += (len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0)
            todo += children.get(q, [])
        ends = ",".join("null" if c is None else str(c) for c in members if rebuilt[c] == p)
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows: list[tuple], **how) -> None:
    got = prefix_trie.trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), **how).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(rows), key=repr)


def talk(conv, texts) -> list[tuple]:
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def odd_rows() -> list[tuple]:
    rows = []
    for c in range(0, 260, 3):
        rows += talk(c, ["hello", "hi", f"ask {c % 4}", "well", "bye", "so"][: 1 + c % 6])
    for c in [*range(400, 420), 5, -7, -100, -150, 10**12, 10**12 + 7]:
        rows += talk(c, ["hello", "hi", "same", "same again", "é" * 50])
    rows += [(700, None, None, None), (700, None, None, None), (700, 2, "user", "x"), (700, 2, "assistant", "x"), (700, 2, "user", "a")]
    rows += [(None, 1, "user", "hello"), (None, None, "user", None), (None, 1, "user", "hello"), (301, 0, "user", "no base")]
    return rows


def test_against_whole_conversations(spark):
    check(spark, odd_rows())


def test_long_conversations_are_taken_in_chunks(spark):
    rng = random.Random(5)
    rows = odd_rows()
    long = [f"w{rng.randrange(3)}" for _ in range(45)]
    for c in [500, 501, 502, 517, 600, 601, 611, 2000, 2003]:
        rows += talk(c, long[: rng.choice([45, 44, 16, 17, 23, 24, 8])])
    rows += [(None, 5, "user", f"n{i}") for i in range(40)]
    check(spark, rows, chunk=8)


def test_one_digest_runs_over_several_families(spark):
    check(spark, [r for c in range(0, 3000, 7) for r in talk(c, ["same", "talk"])])


def test_empty_and_small_chunks(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="chunk"):
        prefix_trie.trie(spark.createDataFrame([], SCHEMA), chunk=5)

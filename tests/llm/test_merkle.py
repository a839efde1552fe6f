from __future__ import annotations

import hashlib
import zlib

from quirespark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, leaf string, idx long"


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def climb(levels: list[list[str]], at: int, h: str) -> tuple[str, str]:
    told = ""
    for level in levels[:-1]:
        a = at // 16 * 16
        left, right = "".join(level[a:at]), "".join(level[at + 1 : a + 16])
        told, h, at = told + left + right, sha(left, h, right), at // 16
    return told, h


def plain(rows: list[tuple]) -> list[tuple]:
    """All rows' proofs, from whole trees in memory."""
    leaves = [(r, sha(*map(field, r[:5]))) for r in rows]
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted([x for x in leaves if x[0][1] == s], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) for s in sources}
    built = {s: fold([h for _, h in trees[s]]) for s in sources}
    top = fold([built[s][-1][0] for s in sources])
    out = []
    for t, s in enumerate(sources):
        for i, (r, h) in enumerate(trees[s]):
            now = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = sha(*map(field, (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))))
            low, x = climb(built[s], i, now)
            high, x = climb(top, t, x)
            out.append((r[0], h, built[s][-1][0], top[-1][0], sha(low + high), x, x == top[-1][0]))
    return out


def check(spark, rows: list[tuple]) -> None:
    got = merkle.audited(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    want = plain(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_against_whole_trees_with_odd_rows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} ÄB") for i in range(60)] + [(1000 + i, "hot", None, None, "Copy") for i in range(275)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (5, None, "de", 3, ""), (5, None, "de", 3, ""), (7, "alone", "fr", 2, "A" * 70_000), (8, "ü", "-", 0, "-"), (-3, "", "", -1, "x:y")]
    check(spark, rows)


def test_more_sources_than_a_run(spark):
    check(spark, [(i, f"s{i % 40}", "en", 1, "A") for i in range(90)])


def test_one_row_and_full_runs(spark):
    check(spark, [(0, "a", "en", 1, "Only")])
    check(spark, [(i, "a", "en", 1, "Z") for i in range(256)])
    check(spark, [(i, "a", "en", 1, "Z") for i in range(17)])


def test_a_changed_row_is_found_and_no_other(spark):
    rows = [(i, "s", "en", 1, f"Word {i}") for i in range(40)]
    for r in merkle.audited(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0)


def test_empty(spark):
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).count() == 0

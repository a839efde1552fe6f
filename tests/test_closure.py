from __future__ import annotations

import random

from quirespark.operators import closure
from quirespark.operators import library as L

SCHEMA = "id long, parent_id long"


def plain(rows: list[tuple]) -> dict:
    """id to (top, depth, circular), by walking up."""
    up = {}
    for i, p in rows:
        if i is not None:
            up[i] = min(x for x in (up.get(i), p) if x is not None) if (up.get(i) is not None or p is not None) else None
    out = {}
    for i in up:
        at, steps = i, 0
        while up.get(at) is not None and up[at] in up and steps <= len(up):
            at, steps = up[at], steps + 1
        out[i] = (None, None, True) if steps > len(up) else (at, steps + 1, False)
    return out


def under(rows: list[tuple], root: int) -> dict:
    found, now, depth = {}, [root] if any(i == root for i, _ in rows) else [], 1
    while now:
        found |= dict.fromkeys(now, depth)
        now, depth = [i for i, p in rows if p in now and i not in found and i is not None], depth + 1
    return found


def test_against_walking(spark):
    rng = random.Random(2)
    for n in (1, 7, 60):
        rows = [(i, rng.choice([None, *range(max(0, i - 4), i), 999]) if i else None) for i in range(n)]
        rows += [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (105, 105), (106, 105), (None, 3)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert {r.id: (r.top, r.depth, r.circular) for r in closure.levels(df).collect()} == plain(rows)
        for root in (0, n // 2, 101, 105, 104, 12345):
            assert {r.id: r.depth for r in closure.below(df, root).collect()} == under(rows, root), root


def test_a_chain_of_five_thousand(spark):
    df = spark.range(5000).selectExpr("id", "case when id > 0 then id - 1 end as parent_id")
    assert [(r.m, r.n) for r in closure.levels(df).selectExpr("max(depth) as m", "count(distinct top) as n").collect() for r in [r]] == [(5000, 1)]
    assert closure.below(df, 4000).selectExpr("count(*) as n", "max(depth) as m").first() == (1000, 1000)


def test_a_cycle_of_two_is_deleted_whole(spark):
    folders = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], SCHEMA)
    mapping = spark.createDataFrame([(10, 3), (11, 4)], "paper_id long, folder_id long")
    papers = spark.createDataFrame([(10,), (11,)], "id long")
    f, m, p = L.delete_folder(folders, mapping, papers, 1, physical=True)
    assert [r.id for r in f.collect()] == [4] and [r.paper_id for r in m.collect()] == [11] and [r.id for r in p.collect()] == [11]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert closure.levels(df).count() == 0 and closure.below(df, 1).count() == 0

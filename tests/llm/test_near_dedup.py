from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import near_dedup as N


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, radius=4):
    roots = list(range(len(fps)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                a, b = find(i), find(j)
                roots[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=100)
@given(st.text(alphabet="abAB Éé\n\t\x0b", max_size=80))
def test_fingerprint(text):
    assert N.fingerprint(text.encode()) == brute_fingerprint(text)


def near(rng, n, groups):
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    more = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in base[:groups] for _ in range(6)]
    return np.unique(np.concatenate([base, np.array(more, np.uint64)]))


@pytest.mark.parametrize("shard", [16, 100, 16_384])
def test_links_lose_nothing(spark, shard):
    fps = near(np.random.default_rng(1), 500, 60)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = N.links(distinct, shard=shard)
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    roots = np.arange(len(fps))
    pairs = [(at[r.a], at[r.b]) for r in edges.collect()]
    if pairs:
        a, b = map(np.array, zip(*pairs))
        N.merge(roots, a, b)
    assert roots.tolist() == brute_roots(fps)


def test_a_dense_ball_gives_few_links(spark):
    """Thousands of fingerprints within a few bits: one link each at most in a shard, not all pairs."""
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([sum(1 << int(k) for k in rng.choice(20, 3, replace=False)) for _ in range(3000)], np.uint64))
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = N.links(distinct, shard=200)
    assert edges.count() <= 40 * len(fps)
    rows = N.components(edges).collect()
    assert len({r.root for r in rows}) == 1 and len({r.node for r in rows} | {r.root for r in rows}) == len(fps)


def test_a_hot_block_makes_no_large_group(spark):
    """A third of all fingerprints share their lowest 16 bits, so that no tree over that block can part them."""
    rng = np.random.default_rng(5)
    own = rng.integers(0, 2**63, 3000).astype(np.uint64)
    own[:1000] &= np.uint64(2**64 - 2**16)
    own[1000:1040] = own[:40] ^ np.uint64(5 << 30)
    fps = np.unique(own)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    dealt, _ = N.deal(distinct, 4, 4, shard=100, sample=512)
    sizes = [r["count"] for r in dealt.groupBy("shard", "low", "high").count().collect()]
    assert dealt.filter("high > 0").count() > 0 and max(sizes) <= 4 * 100
    roots, at = np.arange(len(fps)), {int(x): i for i, x in enumerate(fps.view(np.int64))}
    N.merge(roots, *map(np.array, zip(*[(at[r.a], at[r.b]) for r in N.links(distinct, shard=100, sample=512).collect()])))
    assert roots.tolist() == brute_roots(fps)


def test_links_of_other_radius(spark):
    fps = near(np.random.default_rng(3), 150, 40)
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for radius, blocks in ((1, 1), (3, 2), (6, 4)):
        roots = np.arange(len(fps))
        at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
        pairs = [(at[r.a], at[r.b]) for r in N.links(distinct, radius=radius, blocks=blocks, shard=20).collect()]
        if pairs:
            N.merge(roots, *map(np.array, zip(*pairs)))
        assert roots.tolist() == brute_roots(fps, radius)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


LONG = "the quick brown fox jumps over the lazy dog and runs far away from here " * 20


def documents():
    base = [LONG + f"end {i}" for i in range(5)]
    return [(i + 10, t) for i, t in enumerate(base)] + [(3, base[0]), (3, base[0]), (None, base[0]), (40, ""), (41, None), (42, " \n"), (50, "short text"), (51, "SHORT text"), (52, "another thing altogether here"), (7, "lone words far from all the rest of them")]


def test_documents_against_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, component_id string")
    got = N.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(fps)
    least = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == sorted(((d, f, least[r]) for (d, _), f, r in zip(rows, fps, roots)), key=repr)


def test_drop_keeps_one_of_each_group(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, keeper int")
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = len(set(brute_roots([brute_fingerprint(t) for _, t in rows])))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == groups and sorted(ids) == sorted({r.component_id for r in N.near_duplicates(docs).collect()})


def test_empty_and_alone(spark):
    kind = "doc_id long, text string"
    assert N.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert N.drop_near_duplicates(spark.createDataFrame([], kind)).count() == 0
    nulls = N.near_duplicates(spark.createDataFrame([(None, "a"), (None, "a")], kind)).collect()
    assert [r.component_id for r in nulls] == [None, None]
    assert N.drop_near_duplicates(spark.createDataFrame([(None, "a"), (None, "a")], kind)).count() == 1

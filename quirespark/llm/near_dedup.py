"""SimHash near-duplicates, linked exactly through a forest of vantage-point trees.

A pair of 64-bit fingerprints that differ in at most ``radius`` bits differs in at most ``radius // blocks`` bits in one of
``blocks`` equal blocks of bits. For each block there is a vantage-point tree over the Hamming distance in that block. Its upper levels are
fitted on a bounded sample and deal fingerprints to shards; by the triangle bound a fingerprint can have partners only in
shards whose ring its ball reaches, and it visits just those. Each shard goes on splitting by vantage points until a few
fingerprints are left, compares those in full, and returns no pairs but one link from each fingerprint to the smallest one of
its local group. Spark joins then connect the groups.

Defined results: a null or empty text has no words and fingerprint zero, which links like any other. Repeated rows link as
equal fingerprints. A null doc_id is linked too, and counts as larger than any other; a group of nulls alone has the null
component_id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, holds, per_slice, shielded, text_key, utf8, written

#: Fingerprints that a comparison in full takes at once, on either side.
FULL = 512
#: Fingerprints that the upper levels of the trees are fitted on: so many for each shard, within these bounds (the greater is 2 MB).
EACH, SAMPLE, MOST = 4, 4096, 1 << 18
#: Fingerprints at home in one shard of a tree, about; where one block of bits is the same in many more, the shard is dealt to pairs of salts.
SHARD = 16_384


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The majority bits of XXH64 (seed 42) over all word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle]))
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        a, b = starts[at : at + 65_536].tolist(), (ends[shingle - 1 :][at : at + 65_536] - 1).tolist()
        hashes = np.fromiter((xxhash.xxh64_intdigest(flat[i:j], 42) for i, j in zip(a, b)), np.uint64, len(a))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint's bits as a signed long) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        holds()
        fps = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return rows.mapInArrow(per_slice(make, 500), "doc_id long, text_key long, fp long")


# --- the trees -----------------------------------------------------------------------------------------------------------


def block_masks(blocks: int) -> list[int]:
    width = 64 // blocks
    return [((1 << width) - 1) << (width * b) for b in range(blocks)]


def _split(values: np.ndarray, mask: np.uint64, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point of ``values`` and the ring that halves them best, or None where they don't differ under the mask."""
    best, found = 0, None
    for k in range(min(tries, len(values))):
        point = values[(k * 7919) % len(values)]
        dist = np.bitwise_count((values ^ point) & mask)
        ring = int(np.median(dist))
        for r in (ring, ring - 1):
            inner = int((dist <= r).sum())
            if (even := min(inner, len(values) - inner)) > best:
                best, found = even, (point, r)
        if best > 0.4 * len(values):
            break
    return found


def fit_tree(sample: np.ndarray, mask: int, depth: int) -> list[tuple[int, int] | None]:
    """A binary tree in heap order: node i has (vantage point, ring) and the children 2i+1 (inside) and 2i+2 (outside)."""
    nodes: list[tuple[int, int] | None] = [None] * (2**depth - 1)
    todo = [(0, sample)]
    while todo:
        i, values = todo.pop()
        if i >= len(nodes) or len(values) < 2 or (cut := _split(values, np.uint64(mask))) is None:
            continue
        nodes[i] = (int(cut[0]), cut[1])
        inside = np.bitwise_count((values ^ cut[0]) & np.uint64(mask)) <= cut[1]
        todo += [(2 * i + 1, values[inside]), (2 * i + 2, values[~inside])]
    return nodes


def leaves(fps: np.ndarray, nodes: list[tuple[int, int] | None], mask: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves that the balls of radius ``reach`` touch; with reach 0, the home leaf of each row.

    A node that doesn't split sends everything inside.
    """
    done_rows, done_leaves, todo = [], [], [(0, np.arange(len(fps)))]
    while todo:
        i, rows = todo.pop()
        if not len(rows):
            continue
        if i >= len(nodes):
            done_rows.append(rows)
            done_leaves.append(np.full(len(rows), i - len(nodes)))
            continue
        if nodes[i] is None:
            todo.append((2 * i + 1, rows))
            continue
        point, ring = nodes[i]
        dist = np.bitwise_count((fps[rows] ^ np.uint64(point)) & np.uint64(mask)).astype(np.int64)
        todo += [(2 * i + 1, rows[dist - reach <= ring]), (2 * i + 2, rows[dist + reach > ring])]
    if not done_rows:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate(done_rows), np.concatenate(done_leaves)


# --- one shard -----------------------------------------------------------------------------------------------------------


def merge(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of ``a[i]`` and ``b[i]`` in ``roots``, in place: each root hooks to the smallest root it meets."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = roots[roots]
            if np.array_equal(up, roots):
                break
            roots[:] = up


def _compare(fps: np.ndarray, roots: np.ndarray, members: np.ndarray, guests: np.ndarray, radius: int) -> None:
    for i in range(0, len(members), FULL):
        own = members[i : i + FULL]
        for j in range(0, len(guests), FULL):
            other = guests[j : j + FULL]
            near = np.bitwise_count(fps[own][:, None] ^ fps[other][None, :]) <= radius
            x, y = np.nonzero(near)
            if len(x):
                merge(roots, own[x], other[y])


def link_shard(fps: np.ndarray, home: np.ndarray, mask: int, near: int, radius: int) -> np.ndarray:
    """Index of the smallest fingerprint of each one's local group: links of members at home with all visitors, and each other.

    Splits by vantage points under the block's mask while those tell fingerprints apart, then by the whole 64 bits.
    """
    order = np.argsort(fps, kind="stable")
    fps, home = fps[order], home[order]
    roots = np.arange(len(fps))
    todo = [(np.flatnonzero(home), np.arange(len(fps)), mask, near)]
    while todo:
        members, guests, m, reach = todo.pop()
        if not len(members) or not len(guests):
            continue
        cut = None
        if len(members) > FULL:
            cut = _split(fps[members], np.uint64(m))
            if cut is None and m != 2**64 - 1:
                todo.append((members, guests, 2**64 - 1, radius))
                continue
        if cut is None:
            _compare(fps, roots, members, guests, radius)
            continue
        dm, dg = (np.bitwise_count((fps[x] ^ cut[0]) & np.uint64(m)).astype(np.int64) for x in (members, guests))
        todo += [(members[dm <= cut[1]], guests[dg - reach <= cut[1]], m, reach), (members[dm > cut[1]], guests[dg + reach > cut[1]], m, reach)]
    out = np.empty(len(fps), np.int64)
    out[order] = order[roots]
    return out


def deal(distinct: DataFrame, radius: int, blocks: int, shard: int = SHARD, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """(shard, low, high, fp, home) of all fingerprints and the shards they visit, and how many shards a tree has. Trees have as many levels as the number of fingerprints asks for.

    A shard of more than three times ``shard`` rows is dealt again: every row has a salt, and goes to the pairs (low, high) of its own salt with every other, so that
    any two rows meet and no group has more than about two salts' rows, of ``shard`` each. The rows of such a shard grow with the square of its size.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard)))
    seen = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(min(MOST, max(sample, EACH << depth))).collect()], np.int64).view(np.uint64)
    near, masks = radius // blocks, block_masks(blocks)
    trees = spark.sparkContext.broadcast([fit_tree(seen, m, depth) for m in masks])
    n_leaves = 2**depth

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, nodes in enumerate(trees.value):
                home = np.zeros(len(fps), np.int64)
                rows, leaf = leaves(fps, nodes, masks[t], 0)
                home[rows] = leaf
                rows, leaf = leaves(fps, nodes, masks[t], near)
                keep = leaf >= home[rows]  # of two shards, the later one compares the pairs between them
                rows, leaf = rows[keep], leaf[keep]
                yield pa.RecordBatch.from_arrays([pa.array(leaf + t * n_leaves, pa.int64()), pa.array(fps[rows].view(np.int64)), pa.array(leaf == home[rows])], names=["shard", "fp", "home"])

    dealt = distinct.select("fp").mapInArrow(visits, "shard long, fp long, home boolean")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 3 * shard)
    large = written(sizes.select("shard", F.ceil(F.col("n") / shard).cast("int").alias("of")), "large")
    if large.isEmpty():
        return dealt.select("shard", F.lit(0).alias("low"), F.lit(0).alias("high"), "fp", "home"), n_leaves
    salted = dealt.join(large, "shard", "left").withColumn("of", F.coalesce("of", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("of")).cast("int"))
    paired = salted.withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
    return paired.select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "home"), n_leaves


def links(distinct: DataFrame, radius: int = 4, blocks: int = 4, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(a, b) for fingerprints of a column fp, each once in the table: links whose groups are those of all pairs within ``radius``.

    At most one link for each fingerprint and each group that it is in; never the pairs of a group.
    """
    dealt, n_leaves = deal(distinct, radius, blocks, shard, sample)
    near, masks = radius // blocks, block_masks(blocks)

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        roots = link_shard(fps, rows["home"].to_numpy(bool), masks[key[0] // n_leaves], near, radius)
        own = roots != np.arange(len(fps))
        return pd.DataFrame({"a": fps[own].view(np.int64), "b": fps[roots[own]].view(np.int64)})

    return dealt.groupBy("shard", "low", "high").applyInPandas(link, "a long, b long")


# --- groups --------------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of all nodes of the links (a, b): root is the smallest node reachable.

    Large-star and small-star steps, each a min per node and a join, until nothing changes; every round is a written table.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(down).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"links still changed after {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 4) -> DataFrame:
    """Every row's doc_id, text_key, fp and component_id, and whether it is the row of its group to keep (``keeper``).

    All rows that equal the keeper in doc_id and text have ``keeper`` true.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    each = written(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(each, radius, blocks))
    grouped = written(each.join(roots, each.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = written(grouped.groupBy("root").agg(F.min("first").alias("keep")), "firsts")  # a table, so that the join below can split a large group
    labels = grouped.join(firsts, "root").select("fp", F.col("keep.doc_id").alias("component_id"), F.col("keep.text_key").alias("keep_key"))
    return rows.join(labels, "fp").select("doc_id", "text_key", "fp", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("keep_key"))).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 4) -> DataFrame:
    """The documents with one row of each group of near-duplicates: that with the smallest doc_id; all columns as they are."""
    found = written(near_duplicates(docs, shingle, radius, blocks), "groups")
    keys = found.groupBy("doc_id", "text_key").agg(F.first("keeper").alias("keeper"), F.count("*").alias("n")).filter("not keeper or n > 1")
    marks = written(keys.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "keeper"), "marks")
    rows, back = shielded(docs, ("doc_id", "text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key"))
    kept = rows.join(marks, same, "left_anti")
    again = marks.filter("keeper")
    if not again.isEmpty():
        once = rows.join(again, same, "left_semi").withColumn("__key", text_key()).dropDuplicates(["doc_id", "__key"]).drop("__key")
        kept = kept.unionByName(once)
    return back(kept)

"""Packing of token pieces into sequences by linear grouping (de la Vega and Lueker), then best fit.

Pieces are dealt at random to shards of a bounded number of pieces, which are packed apart; a shard wastes at most part of its last few
sequences. The emptiest sequences of all shards are therefore opened and packed together, in shards again if they are many, so that waste doesn't grow with the number of shards. In a shard, large lengths are sorted and cut into groups of equal size; each length counts as the
greatest of its group. The few sizes left are packed by a linear programme over configurations (which sizes share a
sequence), whose columns are found by a knapsack over the sequence. Whole multiples of its configurations are filled with actual
pieces; what is left of the large pieces and all small ones go, longest first, where they fit best.

Defined results: a null or empty text is one piece, the end id alone. Repeated rows are packed each. A null doc_id stays null.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, holds, strings, written
from .common import pieces as slices
from .tokens import text_ids

PIECES = "doc_id long, row long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, plain_marks: bool = True) -> DataFrame:
    """Every row's ids and the end id, cut into pieces of ``length`` where they are longer. ids: little-endian unsigned 32-bit; row tells rows apart. plain_marks: see ``TextIds``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("text ids", text_ids.cache_clear)
        encode = text_ids(tokenizer, plain_marks)
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in (x for b in batches for x in slices(b, 500)):
            out = []
            for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
                ids = np.append(encode(text), np.array([end_id], encode.dtype))
                for k, at in enumerate(range(0, len(ids), length)):
                    own = ids[at : at + length]
                    out.append((doc_id, row, k, at, len(own), own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(cut, PIECES)


# --- one shard -----------------------------------------------------------------------------------------------------------


def best_configuration(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """How many of each size make the most worth in ``room``: a knapsack, one more piece a round."""
    best, came = np.zeros(room + 1), []
    while True:
        new, by = best.copy(), np.full(room + 1, -1)
        for k, s in enumerate(sizes):
            if s > room:
                continue
            v = best[: room + 1 - s] + worth[k]
            better = v > new[s:] + 1e-12
            new[s:][better] = v[better]
            by[s:][better] = k
        if (by < 0).all():
            break
        came.append(by)
        best = new
    counts, at = np.zeros(len(sizes), np.int64), room
    for by in reversed(came):
        if by[at] >= 0:
            counts[by[at]] += 1
            at -= sizes[by[at]]
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how often) of the linear programme that meets the demand with the fewest sequences."""
    k = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        often, worth = inverse @ demand, inverse.sum(0)
        column = best_configuration(sizes, worth, room).astype(float)
        if column @ worth <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, often / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    often = np.linalg.solve(basis, demand)
    return [(basis[:, j].round().astype(np.int64), max(0.0, often[j])) for j in range(k)]


#: Numbers of groups that a shard tries: few leave gaps that small pieces fill, many round less.
GROUPS = (16, 12, 24, 32)


def pack_shard(lengths: np.ndarray, room: int, large: float = 1 / 4) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, with the number of groups that needs the fewest sequences."""
    best, least = None, -(-int(lengths.sum()) // room)
    for groups in GROUPS:
        found = pack_grouped(lengths, room, groups, large)
        if best is None or found[0].max(initial=-1) < best[0].max(initial=-1):
            best = found
        if best[0].max(initial=-1) + 1 <= least:
            break
    return best


def pack_grouped(lengths: np.ndarray, room: int, groups: int, large: float) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece: linear grouping of lengths over ``room * large``, best fit for the others."""
    n = len(lengths)
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    used: list[int] = []  # of each sequence

    def put(i: int, s: int) -> None:
        sequence[i], offset[i] = s, used[s]
        used[s] += int(lengths[i])

    order = np.argsort(-lengths, kind="stable")
    whole = order[lengths[order] == room]
    for i in whole:
        used.append(0)
        put(i, len(used) - 1)
    rest = order[len(whole) :]
    big = rest[lengths[rest] > room * large]
    if len(big):
        cuts = np.array_split(big, min(groups, len(big)))  # longest first
        merged: dict[int, list[int]] = {}
        for g in cuts:  # groups whose greatest lengths are equal are one size
            merged.setdefault(int(lengths[g[0]]), []).extend(g.tolist())
        sizes, stock = np.array(list(merged)), list(merged.values())
        at = [0] * len(stock)
        for counts, often in configurations(sizes, np.array([len(s) for s in stock], float), room):
            for _ in range(int(often + 1e-6)):
                if any(at[k] + c > len(stock[k]) for k, c in enumerate(counts)):
                    break
                used.append(0)
                for k in np.flatnonzero(counts):
                    for _ in range(counts[k]):
                        put(stock[k][at[k]], len(used) - 1)
                        at[k] += 1
    # best fit, longest first: sequences by what is free in them
    free: dict[int, list[int]] = {}
    for s, u in enumerate(used):
        if u < room:
            free.setdefault(room - u, []).append(s)
    rooms = sorted(free)
    for i in rest[sequence[rest] < 0]:
        need = int(lengths[i])
        at_room = bisect.bisect_left(rooms, need)
        if at_room < len(rooms):
            f = rooms[at_room]
            s = free[f].pop()
            if not free[f]:
                del free[f], rooms[at_room]
        else:
            used.append(0)
            s, f = len(used) - 1, room
        put(i, s)
        if f > need:
            if f - need not in free:
                free[f - need] = []
                bisect.insort(rooms, f - need)
            free[f - need].append(s)
    return sequence, offset


def emptiest(sequence: np.ndarray, lengths: np.ndarray, most: int, pieces: int) -> np.ndarray:
    """Whether each piece is in one of the ``most`` sequences with the fewest tokens, of which as many are taken as hold at most ``pieces`` pieces in all."""
    held, used = np.bincount(sequence), np.bincount(sequence, weights=lengths)
    order = np.argsort(used, kind="stable")[:most]
    return np.isin(sequence, order[np.cumsum(held[order]) <= pieces])


def packer(before: int, length: int, shard: int, again: int):
    """Packs one shard's rows; its sequences are numbered after those of the ``before`` shards of earlier rounds."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], kind="stable", ignore_index=True).drop(columns="__shard")
        lengths = rows["length"].to_numpy(np.int64)
        sequence, offset = pack_shard(lengths, length)
        return rows.assign(sequence_id=sequence + (before + int(key[0]) << 32), offset=offset, __open=emptiest(sequence, lengths, again, shard // 8))

    return one


def pack(pieces: DataFrame, length: int = 4096, shard: int = 4_096, again: int = 16) -> DataFrame:
    """The pieces with sequence_id and offset; needs row, piece and length, and keeps other columns.

    Where there are several shards, the ``again`` emptiest sequences of each (with an eighth of a shard's pieces at most) are packed once more, together, until these are one shard.
    """
    todo, done, before = written(pieces, "pieces"), None, 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    while True:
        shards = max(1, math.ceil(todo.count() / shard))
        dealt = todo.withColumn("__shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int"))
        packed = dealt.groupBy("__shard").applyInPandas(packer(before, length, shard, again), f"{fields}, sequence_id long, offset long, __open boolean")
        if shards > 1:
            packed = written(packed, "packed")
        kept = (packed.filter("not __open") if shards > 1 else packed).drop("__open")
        done = kept if done is None else done.unionByName(kept)
        if shards == 1:
            return done
        todo, before = packed.filter("__open").select(*[F.col(f"`{c}`") for c in pieces.columns]), before + shards


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit) of ``pieces`` as ``packed`` places them."""
    placed = packed.select("row", "piece", "sequence_id", "offset").join(pieces.select("row", "piece", "length", "ids"), ["row", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    ids = F.expr("aggregate(parts, cast('' as binary), (all, p) -> concat(all, p.ids))")
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts, 0L, (n, p) -> n + p.length)").alias("n_tokens"), ids.alias("ids"))

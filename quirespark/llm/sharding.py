"""Sharding by jump consistent hashing (Lamping and Veach): shards without a ring table, and few moves when shards are added.

A row's shard follows from its key and the number of shards alone; of n shards, an (n + 1)th takes its share of rows and no row
moves between the others. Inside a shard rows are numbered without gaps, in the order of key and text: the table of keys (never the texts) is
sorted by ranges, and each part's numbers begin where the parts before it end.

Defined results: a null text has no bytes. A null doc_id is a key of its own, as the text 'null'. Repeated rows share a shard and
have slots of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, written

STEP = 2862933555777941757


def key_of(column: str) -> Column:
    """60 bits of the MD5 of the key's decimal text: stable across engines and releases."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every key, all keys jumping at once until each one's next jump leaves the range."""
    key = keys.astype(np.uint64)
    at, to = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(going):
            at[going] = to[going]
            key[going] = key[going] * np.uint64(STEP) + np.uint64(1)
            to[going] = ((at[going] + 1) * (2.0**31 / ((key[going] >> np.uint64(33)).astype(float) + 1))).astype(np.int64)
            going = going[to[going] < shards]
    return at


def with_shards(rows: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of the column ``key``, 0 to shards - 1."""

    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards), dtype="int32")

    return rows.withColumn(name, F.pandas_udf(of, "int")(key_of(key)))


def numbered(rows: DataFrame, group: str, by: list[str], name: str = "slot") -> DataFrame:
    """``rows`` with gapless numbers from 0 in each group, in the order of ``by``; no group has to fit one task.

    The parts of a sort by ranges are written with their part's number; a small sum over parts gives where each begins.
    """
    order = [F.asc_nulls_first(c) for c in [group, *by, "__row"]]
    parts = rows.withColumn("__row", F.monotonically_increasing_id())
    parts = written(written(parts, "rows").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    sizes = parts.groupBy(group, "__part").agg(F.count("*").alias("__n"), F.min(F.struct(*[F.struct(F.col(c).isNotNull(), c) for c in by], "__row")).alias("__first"))
    begin = F.sum("__n").over(W.partitionBy(group).orderBy("__first").rowsBetween(W.unboundedPreceding, -1))
    begins = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(begin, F.lit(0)).alias("__begin"))
    inside = F.row_number().over(W.partitionBy(group, "__part").orderBy(*order[1:])) - 1
    found = parts.withColumn("__inside", inside).join(begins, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    return found.withColumn(name, (F.col("__begin") + F.col("__inside")).cast("long")).drop("__row", "__part", "__group", "__of", "__begin", "__inside")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 16), text_crc32, shard, slot and grown_shard (with one shard more) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_shards(with_shards(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"])

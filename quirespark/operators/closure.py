"""Trees that are kept as links to parents, of any depth, by doubling the links.

Every row begins with a link to its parent; in each round it takes over the link of the row that its own one leads to, so links grow twice as long, and after log2(depth) rounds all lead past the
top. Each round is one join by sorting, since a broadcast would send the table through the driver in every round, and a written table. Links that are longer than the table has rows go round in a cycle.

Defined results: a parent that the table doesn't have counts as none. Of several rows with one id the one with the smallest parent counts. A null id is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import drop, stored


def linked(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """id and up: each row's parent, where the table has it."""
    own = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(parent).alias("up"))
    there = own.select(F.col("id").alias("up"), F.lit(True).alias("__there")).hint("merge")
    return own.join(there, "up", "left").select("id", F.when(F.col("__there"), F.col("up")).alias("up"))


def doubled(state: DataFrame, taken: dict[str, Column]) -> DataFrame:
    """The state (id, up and more) after as many rounds as it needs. ``taken``: the columns of the next state, of ``s`` (a row) and ``t`` (the row that its link leads to)."""
    spark, now, length = state.sparkSession, stored(state, "links"), 1
    n = now.count()
    while length <= n and not now.filter("up is not null").isEmpty():
        going, there = now.filter("up is not null").alias("s"), now.alias("t").hint("merge")
        far = going.join(there, F.col("s.up") == F.col("t.id"), "left").select("s.id", *[c.alias(k) for k, c in taken.items()])
        before, length = now, length * 2
        now = stored(now.filter("up is null").unionByName(far), "links")
        drop(spark, before.inputFiles()[0].rpartition("/")[0])
    return now


def levels(rows: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """id, top (the topmost row above it, or itself), depth (1 for a top) and circular: whether it is on a cycle or below one, where top and depth are null."""
    start = linked(rows, key, parent).select("id", "up", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    found = doubled(start, {"up": F.col("t.up"), "top": F.col("t.top"), "steps": F.col("s.steps") + F.col("t.steps")})
    circular = F.col("up").isNotNull()
    return found.select("id", F.when(~circular, F.col("top")).alias("top"), F.when(~circular, F.col("steps") + 1).alias("depth"), circular.alias("circular"))


def below(rows: DataFrame, root, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """id and depth (from 1) of one row and all below it; on a cycle through the root, each of its rows once. Empty where the root isn't there."""
    at_root = F.col("id") == F.lit(root)
    links = linked(rows, key, parent)
    start = links.select("id", F.when(~at_root, F.col("up")).alias("up"), F.when(at_root, 0).cast("long").alias("hit"), F.lit(1).cast("long").alias("length"))
    # a link's row knows how far above it the root is, if that is nearer than the link is long
    hit = F.coalesce("s.hit", F.col("s.length") + F.col("t.hit"))
    found = doubled(start, {"up": F.when(hit.isNull(), F.col("t.up")), "hit": hit, "length": F.col("s.length") * 2})
    return found.filter("hit is not null").select("id", (F.col("hit") + 1).cast("int").alias("depth"))

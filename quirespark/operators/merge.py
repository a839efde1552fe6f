"""Two copies of a library: what one lacks of the other, and merges that insert, overwrite or update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table_keys(rows: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """table_name and pk, the key as a JSON array."""
    return rows.select(F.lit(table).alias("table_name"), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("pk"))


def missing_keys(source: DataFrame, target: DataFrame, always: tuple[str, ...] = ("app_config",)) -> DataFrame:
    """(table_name, pk) of the source that the target lacks; tables in ``always`` in full."""
    kept = source.filter(F.col("table_name").isin(*always)) if always else source.limit(0)
    rest = source.filter(~F.col("table_name").isin(*always)) if always else source
    return kept.unionByName(rest.join(target.select("table_name", "pk"), ["table_name", "pk"], "left_anti"))


def file_differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """path, size and state: missing, conflict (no file, or another size or hash) or identical."""
    t = target.select("path", F.col("size").alias("t_size"), F.col("sha256").alias("t_sha256"), F.col("is_file").alias("t_is_file"))
    differs = ~F.col("t_is_file") | (F.col("size") != F.col("t_size")) | (F.col("sha256") != F.col("t_sha256"))
    joined = source.join(t, "path", "left")
    return joined.select("path", "size", F.when(F.col("t_is_file").isNull(), "missing").when(differs, "conflict").otherwise("identical").alias("state"))


def statistics(keys: DataFrame, files: DataFrame) -> DataFrame:
    """One row: tables, rows, files and bytes to fetch, and conflicts."""
    k = keys.agg(F.countDistinct("table_name").alias("tables"), F.count("*").alias("rows"))
    f = files.agg(F.count_if(F.col("state") == "missing").alias("files"), F.coalesce(F.sum(F.when(F.col("state") == "missing", F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("state") == "conflict").alias("conflicts"))
    return k.join(F.broadcast(f), F.lit(True))  # one row each


def insert_only(target: DataFrame, delta: DataFrame, uniques: list[list[str]], order: str) -> DataFrame:
    """The target, and rows of the delta that clash with none of its unique keys; of rows of the delta that clash, the first by ``order`` stays."""
    new = delta
    for keys in uniques:
        new = new.join(target.select(*keys).distinct(), keys, "left_anti")
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        rank = F.row_number().over(W.partitionBy(*keys, F.when(known, F.lit(0)).otherwise(F.col(order))).orderBy(order))
        new = new.withColumn("__k", rank).filter("__k = 1").drop("__k")
    return target.unionByName(new)


def overwrite(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


STATUSES = ("translate", "never_translate", "translate_with_annotation")


def confirmed_terms(terms: DataFrame) -> DataFrame:
    """Of terms that a user has confirmed (en, zh, status, domain): those with a known status, a term, and a translation unless it is kept as it is."""
    ok = F.col("status").isin(*STATUSES) & (F.coalesce(F.trim("en"), F.lit("")) != "") & ((F.coalesce(F.trim("zh"), F.lit("")) != "") | (F.col("status") == "never_translate"))
    return terms.filter(ok)


def upsert(target: DataFrame, delta: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target with ``values`` of rows that the delta has, and the delta's new rows; ``inserted`` marks those."""
    d = delta.select(*keys, F.lit(True).alias("__in"), *[F.col(v).alias(f"__{v}") for v in values])
    t = target.select(*keys, F.lit(True).alias("__was"), *values)
    joined = t.join(d, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("__in"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values], F.col("__was").isNull().alias("inserted"))


def rows_of(source: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The source's rows whose keys are wanted."""
    return source.join(wanted.select(*keys).distinct(), keys, "left_semi")


def insert_strict(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the delta; raises where a key is there already."""
    clash = F.raise_error(F.lit("a row with this key exists")).cast("boolean")
    t = target.select(*keys, F.lit(True).alias("__was")).distinct()
    return target.unionByName(delta.join(t, keys, "left").filter(F.col("__was").isNull() | clash).drop("__was"))

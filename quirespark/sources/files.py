"""Files as tables: inventories, archives of parsed documents, content lists, bundles of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..stored import drop
from . import large
from .bundle import numbered, told, written_at_once
from .large import opened

CONTENT = "array<struct<type:string,text:string,text_level:int,img_path:string,table_body:string>>"


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, size and sha256 of every file below a folder, however large."""
    return large.hashed_files(spark, folder, glob).withColumn("is_file", F.lit(True))


IMAGES = ("png", "jpg", "jpeg", "webp", "gif")


def parsed_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, markdown and content_list of zip files of parsed documents: the first *.md is the text. Their images are a table of their own, ``archive_images``."""
    texts = large.archive_texts(spark, folder, "*.md,*_content_list.json")
    first = lambda end: F.min_by("text", F.when(F.endswith("name", F.lit(end)), F.col("name")))
    return texts.groupBy("path").agg(first(".md").alias("markdown"), first("_content_list.json").alias("content_list"))


def archive_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and content of every image in zip files of parsed documents."""
    rows = large.archive_pieces(spark, folder)
    image = F.lower(F.element_at(F.split("name", r"\."), -1)).isin(*IMAGES)
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("content").alias("h")))), lambda x: x["h"]), ""))
    return rows.filter(image).groupBy("path", "name").agg(whole.alias("content"))


def content_list_markdown(docs: DataFrame, key: str, content: str = "content_list") -> DataFrame:
    """key and markdown built from a content list: titles, texts, equations, images and tables, with a blank line between."""
    items = docs.select(key, F.posexplode(F.from_json(content, CONTENT)).alias("pos", "i"))
    text = F.coalesce("i.text", F.lit(""))
    title = (F.col("i.type") == "title") | (F.coalesce(F.col("i.text_level"), F.lit(0)) > 0)
    marks = F.repeat(F.lit("#"), F.greatest(F.coalesce("i.text_level", F.lit(1)), F.lit(1)))
    part = F.when(F.col("i.type") == "equation", F.concat(F.lit("$$"), text, F.lit("$$"))).when(F.col("i.type") == "image", F.concat(F.lit("![]("), F.coalesce("i.img_path", F.lit("")), F.lit(")"))).when(F.col("i.type") == "table", F.coalesce("i.table_body", F.lit(""))).when(title, F.concat(marks, F.lit(" "), text)).otherwise(text)
    rows = items.select(key, "pos", part.alias("part")).filter(F.trim("part") != "")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "\n\n").alias("markdown"))


def relinked_images(docs: DataFrame, links: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents whose image paths are replaced by the first link (key, pos, name, url) with that path, a path it ends, or its basename.

    Paths are exploded and joined by basename; only then text is rebuilt from its parts.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    image = r"(!\[[^\]]*\]\()([^)]+)\)"
    heads, olds = (F.regexp_extract_all(text, F.lit(image), F.lit(k)) for k in (1, 2))
    paths = docs.select(key, F.explode(F.array_distinct(olds)).alias("old"))
    best = paths.join(links.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (base("old") == base("name"))).groupBy(key, "old").agg(F.min_by("url", "pos").alias("url"))
    maps = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("old", "url"))).alias("urls"))
    own = docs.withColumns({"__heads": heads, "__olds": olds, "__between": F.split(text, image)}).join(maps, key, "left")
    linked = F.transform("__between", lambda x, i: F.concat(x, F.coalesce(F.concat(F.get("__heads", i), F.coalesce(F.try_element_at("urls", F.get("__olds", i)), F.get("__olds", i)), F.lit(")")), F.lit(""))))
    return own.withColumn(text, F.array_join(linked, "")).drop("urls", "__heads", "__olds", "__between")


def bundle_files(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """path, archive_path, size, sha256 and missing of the files that a bundle takes: each path once, numbered in the order of paths; those that aren't ``there`` (path, size, sha256) are told as missing."""
    once = wanted.select("path").distinct().join(there.select("path", "size", "sha256"), "path", "left")
    return numbered(once, "path").select("path", T.bundle_path(F.col("number"), F.col("path")).alias("archive_path"), "size", "sha256", F.col("sha256").isNull().alias("missing"))


def replace_table(rows: DataFrame, path: str, version: int) -> str:
    """Writes a new version beside the old one, which stays for going back, and makes it the current one; returns its path. The pointer is written when all rows are there, so readers see a whole version."""
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")
    written_at_once(path, "current.json", {"version": version})
    return f"{path}/version={version}"


def restored_table(spark: SparkSession, path: str, version: int) -> DataFrame:
    """An earlier version, for going back after a change that failed."""
    return spark.read.parquet(f"{path}/version={version}")


def current_table(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The version that the pointer names, and its number."""
    if (now := told(path, "current.json")) is None:
        raise FileNotFoundError(f"{path} has no version")
    return restored_table(spark, path, now["version"]), now["version"]


def roll_back(path: str, version: int) -> None:
    """Makes an earlier version the current one; later ones stay."""
    if not opened(path)[0].get_file_info(f"{opened(path)[1]}/version={version}/_SUCCESS").is_file:
        raise FileNotFoundError(f"{path} has no version {version}")
    written_at_once(path, "current.json", {"version": version})


def replaced_or_restored(rows: DataFrame, path: str, version: int) -> tuple[DataFrame, int, str | None]:
    """Writes the next version and returns it with its number; where rows can't be made or written, the version before it as it is, and what went wrong. That there is a next version already is no such thing: someone else has written it, and the error is raised."""
    try:
        replace_table(rows, path, version + 1)
    except Exception as e:  # noqa: BLE001 - whatever went wrong, the library goes on with what it had
        if "PATH_ALREADY_EXISTS" in str(e):
            raise
        drop(rows.sparkSession, f"{path}/version={version + 1}")
        return restored_table(rows.sparkSession, path, version), version, str(e)[:500]
    return restored_table(rows.sparkSession, path, version + 1), version + 1, None

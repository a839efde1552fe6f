"""The block operators over documents that are one row each: an array ``body`` of structs (level, text, image_url), whose places are positions.

What ``blocks`` says with windows over a table of blocks is said here inside the row, by functions over arrays that read each block once or twice. Nothing is shuffled; for tables that have blocks as rows, or documents too
long for a row, there are the operators of ``blocks``.

Defined results: as in ``blocks``. A null body is a document without blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def headings(body: str | Column) -> Column:
    """idx, level and text of a body's headings, in order."""
    each = F.transform(body, lambda b, i: F.struct(i.cast("int").alias("idx"), b["level"].alias("level"), b["text"].alias("text")))
    return F.filter(each, lambda h: h["level"] >= 1)


def with_headings(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.filter(F.col(body).isNotNull()).withColumn("__h", headings(body)).withColumn("__n", F.size(body))


def _next(i: Column) -> Column:
    """The position of the heading after the i-th, or the number of blocks."""
    return F.coalesce(F.get("__h", i + 1)["idx"], F.col("__n"))


def contexts(name=lambda h: T.first_text(h["text"])) -> Column:
    """For each block the name of the nearest heading strictly before it, or ''."""
    ahead = F.array_repeat(F.lit(""), F.least(F.coalesce(F.get("__h", F.lit(0))["idx"] + 1, F.col("__n")), F.col("__n")))
    # a heading names the blocks after it up to the next one, that one included
    reach = F.transform("__h", lambda h, i: F.array_repeat(name(h), F.least(_next(i), F.col("__n") - 1) - h["idx"]))
    return F.concat(ahead, F.flatten(reach))


def exploded(docs: DataFrame, key: str, body: str, begin: Column, end: Column, context: bool = False) -> DataFrame:
    """key, idx, level, text, image_url (and context) of the blocks from ``begin`` up to, but without, ``end``."""
    numbered = F.transform(body, lambda b, i: F.struct(i.cast("int").alias("idx"), b["level"].alias("level"), b["text"].alias("text"), b["image_url"].alias("image_url")))
    length = F.greatest(end - begin, F.lit(0))
    zipped = F.arrays_zip(F.slice(numbered, begin + 1, length).alias("b"), F.slice(contexts() if context else F.array_repeat(F.lit(""), F.col("__n")), begin + 1, length).alias("context"))
    rows = docs.select(key, F.explode(zipped).alias("x")).select(key, "x.b.*", "x.context")
    return rows if context else rows.drop("context")


def heading_context(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    own = with_headings(docs, body)
    return exploded(own, key, body, F.lit(0), F.col("__n"), context=True)


def section_ends(docs: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, start_index, end_index, level and heading: each section up to the next heading of any level."""
    ends = F.transform("__h", lambda h, i: F.struct(h["idx"].alias("start_index"), (_next(i) - 1).alias("end_index"), h["level"].alias("level"), h["text"].alias("heading")))
    return with_headings(docs, body).select(key, F.inline(ends))


def with_scope(docs: DataFrame, heading: str, body: str = "body") -> DataFrame:
    """The documents with __s, the first heading that contains ``heading`` (or null), and __stop, where its section ends."""
    own = with_headings(docs, body)
    found = F.filter("__h", lambda h: F.contains(F.lower(F.coalesce(h["text"], F.lit(""))), F.lit(heading.lower())))
    placed = own.withColumn("__s", F.get(found, F.lit(0)))
    after = F.filter("__h", lambda h: (h["idx"] > F.col("__s.idx")) & (h["level"] <= F.col("__s.level")))
    return placed.withColumn("__stop", F.coalesce(F.get(after, F.lit(0))["idx"], F.col("__n")))


def section_scope(docs: DataFrame, key: str, heading: str, body: str = "body") -> DataFrame:
    """Blocks from each document's first heading that contains ``heading`` up to the next one of its level or above; none where it is missing."""
    own = with_scope(docs, heading, body).filter("__s is not null")
    return exploded(own, key, body, F.col("__s.idx"), F.col("__stop"))


def scoped(docs: DataFrame, key: str, heading: str | None, body: str = "body") -> DataFrame:
    """The section, or the whole document where it lacks one, with the heading context."""
    if not heading:
        return heading_context(docs, key, body)
    own = with_scope(docs, heading, body)
    return exploded(own, key, body, F.coalesce("__s.idx", F.lit(0)), F.col("__stop"), context=True)


def section_text(docs: DataFrame, key: str, heading: str, offset: int = 0, page: int = 50, body: str = "body") -> DataFrame:
    """key, paragraph_count, has_more and content of one page of each document's section: no headings' own row, images or empty blocks."""
    own = with_scope(docs, heading, body).filter("__s is not null")
    inside = F.slice(body, F.col("__s.idx") + 2, F.greatest(F.col("__stop") - F.col("__s.idx") - 1, F.lit(0)))
    kept = own.withColumn("__k", F.filter(inside, lambda b: (T.first_text(b["text"]) != "") & b["image_url"].isNull()))
    count = F.size("__k").cast("long")
    shown = kept.filter(count > offset)
    content = F.array_join(F.transform(F.slice("__k", offset + 1, page), lambda b: b["text"]), "\n")
    return shown.select(key, count.alias("paragraph_count"), (count > offset + page).alias("has_more"), content.alias("content"))


def paragraph_context(docs: DataFrame, key: str, target: Column, window: int = 2, body: str = "body") -> DataFrame:
    """Blocks at most ``window`` positions from each document's target, images left out, with is_target and the heading context."""
    own = with_headings(docs, body).withColumn("target", target)
    begin, end = F.greatest(F.col("target") - window, F.lit(0)), F.least(F.col("target") + window + 1, F.col("__n"))
    rows = exploded(own.withColumn("__key", F.struct(F.col(key).alias("k"), "target")), "__key", body, begin, end, context=True)
    near = rows.filter(F.col("image_url").isNull()).select(F.col("__key.k").alias(key), "__key.target", "idx", "text", "context")
    return near.withColumn("is_target", F.col("idx") == F.col("target"))

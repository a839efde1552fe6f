"""Long documents cut into chapters: page ranges, their checks, and results rolled up or merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def chapters(bookmarks: DataFrame, key: str, pages: str = "page_count") -> DataFrame:
    """key, title, start_page and end_page of level-1 bookmarks: up to the page before the next one's, at least one page, the last to the end."""
    own = bookmarks.filter("level = 1").dropDuplicates([key, "page", "title"])
    following = F.lead("page").over(W.partitionBy(key).orderBy("page", "title"))
    return own.select(key, "title", F.col("page").alias("start_page"), F.greatest("page", F.coalesce(following - 1, F.col(pages))).alias("end_page"))


def range_errors(ranges: DataFrame, key: str, pages: str = "page_count") -> DataFrame:
    """Ranges that aren't allowed, with the reason: reversed, out of bounds, or overlapping one that starts before.

    An overlap shows in the greatest end so far, so no pairs are made.
    """
    order = W.partitionBy(key).orderBy("start_page", "end_page")
    ended = F.max("end_page").over(order.rowsBetween(W.unboundedPreceding, -1))
    reason = F.when(F.col("start_page") > F.col("end_page"), "reversed").when((F.col("start_page") < 1) | (F.col("end_page") > F.col(pages)), "out of bounds").when(F.col("start_page") <= ended, "overlap")
    return ranges.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def gaps(ranges: DataFrame, documents: DataFrame, key: str, pages: str = "page_count") -> DataFrame:
    """key, first and last of the stretches of pages that no range covers: before each range from the greatest end so far, and after the last; a document counts as a range past its end."""
    ends = documents.filter(F.col(pages) >= 1).select(key, (F.col(pages) + 1).alias("start_page"), F.col(pages).alias("end_page"), F.col(pages).alias("__n"))
    rows = ranges.filter("start_page <= end_page").select(key, "start_page", "end_page", F.lit(None).cast(documents.schema[pages].dataType).alias("__n")).unionByName(ends)
    whole = W.partitionBy(key)
    before = whole.orderBy("start_page", "end_page").rowsBetween(W.unboundedPreceding, -1)
    first = F.greatest(F.coalesce(F.max("end_page").over(before), F.lit(0)) + 1, F.lit(1))
    last = F.least(F.col("start_page") - 1, F.max("__n").over(whole))
    return rows.select(key, first.alias("first"), last.alias("last")).filter("first <= last")


def uncovered(ranges: DataFrame, documents: DataFrame, key: str, pages: str = "page_count") -> DataFrame:
    """key and page of pages that no range covers; only gaps become rows."""
    return gaps(ranges, documents, key, pages).select(key, F.explode(F.sequence("first", "last")).alias("page"))


def titled(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges in order with chapter_index from 1 and a title where there is none."""
    n = F.row_number().over(W.partitionBy(key).orderBy("start_page"))
    return ranges.withColumn("chapter_index", n).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("chapter_index"))))


def parent_status(jobs: DataFrame, parent: str = "parent_job_id") -> DataFrame:
    """parent, status and progress rolled up from children: a failed or waiting child first, all completed, else the first that runs.

    progress = whole percent of completed children plus the running one's share.
    """
    done, active = F.count_if(F.col("status") == "completed"), ~F.col("status").isin("completed", "failed", "pending", "waiting_term_review")
    rolled = jobs.filter(F.col(parent).isNotNull()).groupBy(parent).agg(
        F.count("*").alias("__n"), done.alias("__done"), F.bool_or(F.col("status") == "failed").alias("__failed"), F.bool_or(F.col("status") == "waiting_term_review").alias("__waiting"),
        F.min(F.when(active, F.struct("chapter_index", "status", "progress"))).alias("__a"),
    )
    status = F.when(F.col("__failed"), "failed").when(F.col("__waiting"), "waiting_term_review").when(F.col("__done") == F.col("__n"), "completed").when(F.col("__a").isNotNull(), F.col("__a.status")).otherwise("pending")
    progress = F.floor((F.col("__done") * 100 + F.coalesce(F.col("__a.progress"), F.lit(0))) / F.col("__n")).cast("int")
    return rolled.select(parent, status.alias("status"), F.when(F.col("__done") == F.col("__n"), 100).otherwise(progress).alias("progress"))


def chapter_rows(parents: DataFrame, ranges: DataFrame, key: str, inherited: list[str]) -> DataFrame:
    """A row for each chapter with its parent's metadata."""
    return titled(ranges, key).join(parents.select(key, *inherited), key).select(F.concat_ws("-", F.col(key).cast("string"), F.col("chapter_index").cast("string")).alias("id"), F.col(key).alias("parent_id"), "chapter_index", F.col("title").alias("chapter_title"), "start_page", "end_page", *inherited)


def merged_children(children: DataFrame, parent: str) -> DataFrame:
    """parent, body, refs: bodies of all children in chapter order, each below a level-1 heading; references in order, each once.

    Children have chapter_index, title, body (array of level and text) and refs. A parent with a child that has no body is left out.
    """
    head = F.array(F.struct(F.lit(1).alias("level"), F.col("title").alias("text")))
    parts = F.array_sort(F.collect_list(F.struct("chapter_index", F.concat(head, F.col("body")).alias("body"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))))
    whole = children.groupBy(parent).agg(parts.alias("__p"), F.bool_and(F.col("body").isNotNull()).alias("__ok")).filter("__ok")
    return whole.select(parent, F.flatten(F.transform("__p", lambda x: x["body"])).alias("body"), F.array_distinct(F.filter(F.flatten(F.transform("__p", lambda x: x["refs"])), lambda r: T.first_text(r) != "")).alias("refs"))

"""Search: word-scored blocks of one or all documents, titles, annotations, history, and duplicates by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import bodies
from .blocks import heading_context, scoped
from .similar import similar_texts


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best by score; ties by the given columns."""
    return scored.filter("score > 0").orderBy(F.desc("score"), *ties).limit(k)


def search_library(papers: DataFrame, query: str, columns: list[str | Column], key: str, domain: str | None = None, k: int = 10) -> DataFrame:
    """Papers by words over several columns; a domain leaves out those with another domain, but not those without one."""
    rows = papers.withColumn("score", T.word_score(F.concat_ws(" ", *columns), query))
    if domain:
        rows = rows.filter(F.coalesce(F.col("domain") == "", F.lit(True)) | F.contains(F.lower("domain"), F.lit(domain.lower())))
    return top(rows, k, key)


def search_document(blocks: DataFrame, key: str, query: str, section: str | None = None, k: int = 8) -> DataFrame:
    """The best blocks of each document's section (or of all of it where it has none), with their heading context; no images."""
    shown = scoped(heading_context(blocks, key), key, section).filter(F.col("image_url").isNull())
    return top(shown.withColumn("score", T.word_score(F.col("text"), query)), k, key, "idx")


def search_bodies(docs: DataFrame, key: str, query: str, section: str | None = None, k: int = 8, body: str = "body") -> DataFrame:
    """The same over documents that are one row each, without a shuffle of blocks."""
    shown = bodies.scoped(docs, key, section, body).filter(F.col("image_url").isNull())
    return top(shown.withColumn("score", T.word_score(F.col("text"), query)), k, key, "idx")


def search_all(blocks: DataFrame, key: str, query: str, k: int = 10) -> DataFrame:
    """The best blocks of all documents with heading context, and ``total``, the number of blocks that match.

    Scores and the total take a scan each and no shuffle of blocks; the context is worked out for the documents of the k best alone, whose keys
    (at most k) are broadcast.
    """
    rows = blocks.withColumn("score", T.word_score(F.col("text"), query))
    total = rows.filter("score > 0").select(F.count("*")).scalar()
    best = top(rows, k, key, "idx")
    own = blocks.join(F.broadcast(best.select(key).distinct()), key, "left_semi")
    context = heading_context(own, key).select(key, "idx", "context")
    return best.join(context, [key, "idx"]).withColumn("total", total).orderBy(F.desc("score"), key, "idx")


def search_annotations(annotations: DataFrame, results: DataFrame, papers: DataFrame, query: str) -> DataFrame:
    """Annotations with any token of the query, with result and paper where they exist."""
    text = F.concat_ws(" ", T.first_text("content"), T.first_text("selected_text"))
    found = annotations.filter(T.contains_any(text, T.annotation_tokens(query)))
    of = results.select(F.col("id").alias("result_id"), "paper_id")
    named = papers.select(F.col("id").alias("paper_id"), "title")
    return found.join(of, "result_id", "left").join(named, "paper_id", "left").withColumn("paper_id", T.first_text("paper_id")).withColumn("title", F.coalesce("title", F.lit("unknown")))


def search_history(messages: DataFrame, sessions: DataFrame, query: str, k: int = 5, wildcards: bool = False) -> DataFrame:
    """The newest assistant messages that hold the query, with the session's title and a snippet. ``wildcards``: % and _ are live."""
    content = F.coalesce("content", F.lit(""))
    hit = F.ilike(content, F.lit(f"%{query}%")) if wildcards else F.contains(F.lower(content), F.lit(query.lower()))
    found = messages.filter((F.col("role") == "assistant") & hit)
    titles = sessions.select(F.col("id").alias("session_id"), F.col("title").alias("session_title"))
    return found.join(titles, "session_id").withColumn("snippet", T.snippet(F.col("content"), query)).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def plain_title(title: Column | str) -> Column:
    return F.lower(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""))


def similar_titles(library: DataFrame, queries: DataFrame, key: str, titles: list[str], least: float = 0.6, most: int = 5) -> DataFrame:
    """(query, key, title, similarity): for each query the ``most`` most similar rows of the library, of those at least that similar; ties by key.

    ``titles`` are the columns of both tables that hold a title (in another language, say); the best of all pairings counts. Titles that are equal
    without case and outer white space are compared once, and of each only the ``most`` smallest keys can be among the best; so copies,
    however many, add rows to no task. Null and empty titles are similar to nothing.
    """
    each = F.explode(F.array(*titles)).alias("__title")
    rows = library.select(F.col(key).alias("__key"), each).withColumn("plain", plain_title("__title")).filter("plain <> ''")
    own = queries.select("query", each).select("query", plain_title("__title").alias("asked")).filter("asked <> ''").distinct()
    pairs = similar_texts(rows.select("plain").distinct(), own.select("asked").distinct(), least)
    first = rows.groupBy("plain", "__key").agg(F.min("__title").alias("__title"))
    first = first.withColumn("__k", F.row_number().over(W.partitionBy("plain").orderBy("__key"))).filter(F.col("__k") <= most).drop("__k")

    def best(found: DataFrame, by: str) -> DataFrame:
        one = found.groupBy(by, "__key").agg(F.max("similarity").alias("similarity"), F.max_by("__title", F.struct("similarity", "__title")).alias("__title"))
        rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("similarity"), "__key"))
        return one.withColumn("__k", rank).filter(F.col("__k") <= most).drop("__k")

    found = best(own.join(best(pairs.join(first, "plain"), "asked"), "asked"), "query")
    return found.select("query", F.col("__key").alias(key), F.col("__title").alias("title"), "similarity")


def citations(found: dict[str, DataFrame], most: dict[str, int]) -> DataFrame:
    """One schema (tool, type, paper_id, block_idx, text) of the first few rows of each tool's result."""
    parts = None
    for tool, rows in found.items():
        own = rows.limit(most.get(tool, 3)).select(F.lit(tool).alias("tool"), *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("paper_id", "string"), ("block_idx", "int"), ("text", "string"))])
        parts = own if parts is None else parts.unionByName(own)
    return parts

"""The named operations of the library over its tables: what an assistant may call, with the arguments and fields that it is told of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..operators import blocks as B
from ..operators import library as L
from ..operators import search as S
from . import front_door
from .front_door import Operations

NOTE = "These are the reader's own notes on this; refer to them where they fit."
NOTES = "array<struct<scope:string,content:string,selected_text:string,block_id:string>>"
#: Headings that are offered where none fits.
OFFERED = 20


def rows_of(*columns: str, order: str) -> Column:
    """A group's rows as an array, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*columns).alias("row")))), lambda x: x["row"])


def library_operations(spark: SparkSession, tables: dict[str, DataFrame]) -> Operations:
    """Fourteen operations over papers, results, annotations, sessions and messages (tables as in ``schema``). Papers are asked by their id, and of their results the latest counts.

    What is told of one paper as a whole is one row; matches and notes are arrays in it. A paper without a result is an error.
    """
    papers, results, annotations = tables["papers"], tables["results"], tables["annotations"]
    text_of = lambda *names: T.first_text(*[n for n in names if n in papers.columns])
    keywords = F.array_join("keywords", " ") if dict(papers.dtypes).get("keywords", "").startswith("array") else F.col("keywords") if "keywords" in papers.columns else F.lit("")

    def newest(paper_id: str | None = None) -> DataFrame:
        if paper_id is None:
            return L.latest(results, "paper_id", "created_at", "id")
        own = L.latest(results.filter(F.col("paper_id") == paper_id), "paper_id", "created_at", "id")
        if own.isEmpty():
            raise LookupError("no result of this paper")
        return own

    def blocks(own: DataFrame) -> DataFrame:
        both = F.concat_ws(" ", F.coalesce("text_en", F.lit("")), F.coalesce("text_zh", F.lit("")))
        return schema.blocks(own).select("paper_id", F.col("block_idx").alias("idx"), F.col("block_idx"), "level", both.alias("text"), T.first_text("text_en").alias("text_en"), T.first_text("text_zh").alias("text_zh"), F.nullif("image_url", F.lit("")).alias("image_url"))

    def in_context(rows: DataFrame) -> DataFrame:
        return B.heading_context(rows, "paper_id", T.first_text("text_zh", "text_en")).withColumnRenamed("context", "heading_context")

    def notes(own: DataFrame, fits: Column | None = None) -> DataFrame:
        """Of each result's paper: its notes, or those that fit."""
        of = own.select(F.col("id").alias("result_id"), "paper_id")
        found = annotations.join(of, "result_id").select("paper_id", "id", "scope", "content", F.nullif("selected_text", F.lit("")).alias("selected_text"), F.nullif("block_id", F.lit("")).alias("block_id"))
        said = F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("selected_text", F.lit("")))
        return found.filter(fits(said)) if fits is not None else found

    def with_notes(answer: DataFrame, found: DataFrame) -> DataFrame:
        held = found.groupBy("paper_id").agg(rows_of("scope", "content", "selected_text", "block_id", order="id").cast(NOTES).alias("annotations"))
        told = answer.join(held, "paper_id", "left")
        return told.withColumn("annotations", F.coalesce("annotations", F.lit(None).cast(NOTES))).withColumn("annotation_note", F.when(F.size("annotations") > 0, NOTE))

    def search_papers(query: str, domain: str | None = None, limit: int = 10) -> DataFrame:
        fields = [F.col(c) for c in ("title", "title_zh", "abstract", "abstract_zh") if c in papers.columns] + [keywords] + [F.col(c) for c in ("domain", "journal") if c in papers.columns]
        found = S.search_library(papers, query, fields, "id", domain, limit)
        year = F.col("year") if "year" in papers.columns else F.lit(None).cast("int")
        shown = {"title": text_of("title"), "title_zh": text_of("title_zh"), "year": year, "domain": text_of("domain"), "journal": text_of("journal"), "abstract_snippet": F.substring(text_of("abstract_zh", "abstract"), 1, 200)}
        return found.select(F.col("id").alias("paper_id"), *[c.alias(k) for k, c in shown.items()])

    def get_paper_outline(paper_id: str) -> DataFrame:
        own = newest(paper_id)
        told = F.from_json("structure_json", schema.STRUCTURE)
        paper = own.select("paper_id", F.struct(*[T.first_text(told[zh]).alias(en) for en, zh in (("title", "标题"), ("title_zh", "标题中文"), ("year", "年份"))]).alias("paper"))
        heads = blocks(own).filter("level >= 1").select("paper_id", "idx", "level", F.col("text_en").alias("heading_en"), F.col("text_zh").alias("heading_zh"))
        return paper.join(heads.groupBy("paper_id").agg(rows_of("level", "heading_en", "heading_zh", order="idx").alias("outline")), "paper_id", "left")

    def search_in_paper(paper_id: str, query: str, section: str | None = None, limit: int = 8) -> DataFrame:
        own = newest(paper_id)
        shown = B.scoped(in_context(blocks(own)), "paper_id", section).filter("image_url is null")
        best = S.top(shown.withColumn("score", T.word_score(F.col("text"), query)), int(limit), "idx")
        placed = best.withColumn("place", F.struct((-F.col("score")).alias("s"), "idx"))
        cut = [F.substring(c, 1, 500).alias(c) for c in ("text_en", "text_zh")]
        matches = placed.select("paper_id", "place", "block_idx", "heading_context", *cut, "score").groupBy("paper_id").agg(rows_of("block_idx", "heading_context", "text_en", "text_zh", "score", order="place").alias("matches"))
        words = query.lower().split() + (section.lower().split() if section else [])
        return with_notes(own.select("paper_id").join(matches, "paper_id", "left"), notes(own, lambda said: T.relevant(said, words)))

    def get_paper_section(paper_id: str, heading: str, offset: int = 0, page: int = 50, start: int = 0) -> DataFrame:
        """``start``: headings before this block aren't meant, where several hold the words."""
        own = newest(paper_id)
        rows = blocks(own)
        scope = B.section_scope(rows, "paper_id", heading, start)
        if scope.isEmpty():
            heads = rows.filter("level >= 1").orderBy("idx").limit(OFFERED).groupBy("paper_id").agg(F.transform(rows_of("text_en", order="idx"), lambda x: x["text_en"]).alias("available_headings"))
            return own.select("paper_id", F.lit(f"no heading '{heading}'").alias("error")).join(heads, "paper_id", "left")
        first = scope.agg(F.min_by(F.struct("text_en", "text_zh"), "idx").alias("h")).first().h
        kept = scope.withColumn("__first", F.min("idx").over(W.partitionBy("paper_id"))).filter((F.col("idx") > F.col("__first")) & F.col("image_url").isNull() & ((F.col("text_en") != "") | (F.col("text_zh") != "")))
        place = F.row_number().over(W.partitionBy("paper_id").orderBy("idx"))
        numbered = kept.withColumn("place", place)
        joined = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.when((F.col("place") > offset) & (F.col("place") <= offset + page), F.struct("place", c)))), lambda x: x[c]), lambda x: x != ""), "\n")
        body = numbered.groupBy("paper_id").agg(joined("text_zh").alias("content_zh"), joined("text_en").alias("content_en"), F.count("*").alias("paragraph_count"))
        count = F.coalesce("paragraph_count", F.lit(0))
        answer = own.select("paper_id", F.lit(first.text_en).alias("section_heading"), F.lit(first.text_zh).alias("section_heading_zh")).join(body, "paper_id", "left")
        answer = answer.withColumns({"content_zh": T.first_text("content_zh"), "content_en": T.first_text("content_en"), "paragraph_count": count, "offset": F.lit(offset), "has_more": count > offset + page})
        words = f"{first.text_en} {first.text_zh}".lower().split()
        return with_notes(answer, notes(own, lambda said: T.relevant(said, words)))

    def get_references(paper_id: str) -> DataFrame:
        return schema.references(newest(paper_id)).select("pos", "text").orderBy("pos")

    def get_annotations(paper_id: str) -> DataFrame:
        return notes(newest(paper_id)).select("scope", "content", "selected_text", "block_id", "id").orderBy("id")

    def search_annotations(query: str) -> DataFrame:
        named = papers.select("id", text_of("title_zh", "title").alias("title"))
        found = S.search_annotations(annotations, results, named, query)
        return found.select("paper_id", F.col("title").alias("paper_title"), "scope", "content", T.first_text("selected_text").alias("selected_text"), T.first_text("block_id").alias("block_id"))

    def search_across_papers(keyword: str, limit: int = 10) -> DataFrame:
        rows = blocks(results.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")).filter("image_url is null").withColumn("score", T.word_score(F.col("text"), keyword))
        total = rows.filter("score > 0").select(F.count("*")).scalar()
        best = S.top(rows, int(limit), "paper_id", "idx")
        framed = in_context(blocks(results.join(best.select("paper_id").distinct(), "paper_id", "left_semi"))).select("paper_id", "idx", "text", "heading_context").distinct()
        titles = papers.select(F.col("id").alias("paper_id"), text_of("title_zh", "title").alias("paper_title"))
        found = best.join(framed, ["paper_id", "idx", "text"]).join(titles, "paper_id")
        return found.select("paper_id", "paper_title", "block_idx", "heading_context", F.substring("text_zh", 1, 400).alias("text_zh"), F.substring("text_en", 1, 400).alias("text_en"), "score", total.alias("total_found")).orderBy(F.desc("score"), "paper_id", "block_idx")

    def get_paragraph_context(paper_id: str, block_idx: int, window: int = 2) -> DataFrame:
        rows = blocks(newest(paper_id))
        if (last := rows.agg(F.max("idx")).first()[0]) is None or not 0 <= block_idx <= last:
            raise IndexError(f"block_idx {block_idx} is not between 0 and {last}")
        near = in_context(rows).filter(F.col("idx").between(block_idx - window, block_idx + window) & F.col("image_url").isNull())
        return near.select("block_idx", (F.col("idx") == block_idx).alias("is_target"), "heading_context", F.substring("text_en", 1, 600).alias("text_en"), F.substring("text_zh", 1, 600).alias("text_zh")).orderBy("block_idx")

    def get_paper_metadata(paper_id: str) -> DataFrame:
        own = papers.filter(F.col("id") == paper_id)
        if own.isEmpty():
            raise LookupError("no such paper")
        shown = {"title": text_of("title"), "title_zh": text_of("title_zh"), "abstract": F.substring(text_of("abstract_zh", "abstract"), 1, 500), "journal": text_of("journal"), "domain": text_of("domain")}
        return own.select(F.col("id").alias("paper_id"), *[c.alias(k) for k, c in shown.items()], *[c for c in ("authors", "year", "keywords") if c in papers.columns])

    def search_chat_history(query: str, limit: int = 5) -> DataFrame:
        return S.search_history(tables["messages"], tables["sessions"], query, int(limit)).select("session_id", "session_title", "created_at", "snippet")

    def query_database(sql: str) -> DataFrame:
        return front_door.query(spark, sql, tables)

    def no_service(**_: object) -> DataFrame:
        raise NotImplementedError("no image service")

    own = (search_papers, get_paper_outline, search_in_paper, get_paper_section, get_references, get_annotations, search_annotations, search_across_papers, get_paragraph_context, get_paper_metadata, search_chat_history, query_database)
    return Operations({f.__name__: f for f in own}, generate_image=no_service, edit_image=no_service)

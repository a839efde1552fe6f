"""Conversations: what is recent, how old turns are shortened, and citations.

Messages are rows with a session key, ``turn`` (the order), ``role`` and ``content``; tool messages also have tool_calls and tool_call_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: User turns above which a level starts, characters above which only recent turns stay, and failures that stop it all.
SNIP, MICRO, FOLD, AUTO, EMERGENCY, FAILURES = 4, 8, 12, 16, 80_000, 3


def with_recent(messages: DataFrame, key: str, users: int = 3) -> DataFrame:
    """Adds ``recent``: at or after the third-last message of the user; everything where there are fewer."""
    later = F.count_if(F.col("role") == "user").over(W.partitionBy(key).orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1))
    return messages.withColumn("recent", later < users)


def totals(messages: DataFrame, key: str) -> DataFrame:
    return messages.groupBy(key).agg(F.sum(F.length(T.first_text("content"))).cast("long").alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"))


#: The labels of a tool result's index.
CUT, FOUND, CHAPTERS, BEST, PAPERS, ROWS, LISTED, CHAPTER, PARAGRAPHS, CONTEXT, TARGET, NOTES, GIST = "[已压缩]", "找到", "章节", "最高分block", "涉及论文", "结果数", "论文列表", "章节", "段落数", "上下文段落数", "目标block", "批注数", "摘要"
SUMMARY = "[对话历史摘要]"
MATCHES, FOUND_PAPERS = "处匹配", "篇论文"


def index_of(content: Column) -> Column:
    """What a tool's result found and where, without its text: by the shape of its JSON, the more specific shapes first."""
    has = lambda k: F.get_json_object(content, f"$.{k}").isNotNull()
    n = lambda k: F.coalesce(F.json_array_length(F.get_json_object(content, f"$.{k}")), F.lit(0))
    distinct = lambda path: F.slice(F.array_distinct(F.filter(F.from_json(F.get_json_object(content, path), "array<string>"), lambda x: T.first_text(x) != "")), 1, 4)
    mark = F.lit(True).alias(CUT)
    matches = F.to_json(F.struct(mark, F.concat(n("matches"), F.lit(MATCHES)).alias(FOUND), distinct("$.matches[*].heading_context").alias(CHAPTERS), F.get_json_object(content, "$.matches[0].block_idx").alias(BEST)))
    across = F.to_json(F.struct(mark, F.concat(n("results"), F.lit(MATCHES)).alias(FOUND), distinct("$.results[*].paper_title").alias(PAPERS)))
    counted = F.to_json(F.struct(mark, F.get_json_object(content, "$.count").alias(ROWS)))
    papers = F.to_json(F.struct(mark, F.concat(n("results"), F.lit(FOUND_PAPERS)).alias(FOUND), distinct("$.results[*].title").alias(LISTED)))
    section = F.to_json(F.struct(mark, T.first_text(F.get_json_object(content, "$.section_heading_zh"), F.get_json_object(content, "$.section_heading")).alias(CHAPTER), F.get_json_object(content, "$.paragraph_count").alias(PARAGRAPHS), F.get_json_object(content, "$.has_more").alias("has_more")))
    context = F.to_json(F.struct(mark, n("context").alias(CONTEXT), F.get_json_object(content, "$.target_block_idx").alias(TARGET)))
    contents = F.transform(F.slice(F.from_json(F.get_json_object(content, "$.annotations"), "array<struct<content:string>>"), 1, 3), lambda x: F.substring(T.first_text(x["content"]), 1, 40))
    notes = F.to_json(F.struct(mark, n("annotations").alias(NOTES), contents.alias(GIST)))
    shaped = F.when(has("matches"), matches).when(has("results") & has("keyword"), across).when(has("results") & has("count"), counted).when(has("results"), papers).when(has("content_zh"), section).when(has("context"), context).when(has("annotations"), notes)
    return F.coalesce(shaped, F.concat(F.substring(content, 1, 150), F.lit(f"…{CUT}")))


def snipped(messages: DataFrame, key: str, longest: int = 200) -> DataFrame:
    """Old, long results of tools as an index."""
    old = with_recent(messages, key)
    cut = ~F.col("recent") & (F.col("role") == "tool") & (F.length(T.first_text("content")) > longest)
    return old.withColumn("content", F.when(cut, index_of(F.col("content"))).otherwise(F.col("content"))).drop("recent")


def folded(messages: DataFrame, key: str, longest: int = 150) -> DataFrame:
    """Old messages of user and assistant, cut short; those that call tools stay."""
    old = with_recent(messages, key)
    calls = F.coalesce(F.size("tool_calls") > 0, F.lit(False)) if "tool_calls" in messages.columns else F.lit(False)
    cut = ~F.col("recent") & F.col("role").isin("user", "assistant") & ~calls & (F.length(T.first_text("content")) > longest)
    return old.withColumn("content", F.when(cut, F.concat(F.substring("content", 1, longest), F.lit("…"))).otherwise(F.col("content"))).drop("recent")


def micro(messages: DataFrame, key: str, snippet: int = 50) -> DataFrame:
    """Old calls of tools and their results as one line for each call, in the calling message's place.

    tool_calls is array<struct<id, name, arguments>>. A result belongs to the last calling message before it, if only tool messages lie between.
    """
    order = W.partitionBy(key).orderBy("turn")
    old = with_recent(messages, key)
    caller = (F.col("role") == "assistant") & (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0) & (T.first_text("content") == "") & ~F.col("recent")
    marked = old.withColumn("caller", caller).withColumn("block", F.max(F.when(F.col("role") != "tool", F.col("turn"))).over(order))
    calls = marked.filter("caller").select(key, F.col("turn").alias("block"), F.posexplode("tool_calls").alias("pos", "c"))
    results = marked.filter((F.col("role") == "tool") & ~F.col("recent")).select(key, "block", F.col("turn").alias("at"), F.col("tool_call_id").alias("id"), F.substring(T.first_text("content"), 1, snippet).alias("found"))
    joined = calls.join(results, (calls[key] == results[key]) & (calls["block"] == results["block"]) & (F.col("c.id") == results["id"]), "left").select(calls[key], calls["block"], "pos", "c", "at", "found")
    line = F.concat(F.lit("[工具调用] "), F.coalesce("c.name", F.lit("unknown")), F.lit("("), F.coalesce("c.arguments", F.lit("")), F.lit(") → "), F.coalesce("found", F.lit("")))
    shown = joined.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    used = joined.filter("at is not null").select(key, F.col("at").alias("turn"))
    kept = marked.join(used, [key, "turn"], "left_anti")
    done = kept.join(shown.withColumnRenamed("block", "turn"), [key, "turn"], "left")
    return done.select(*[F.coalesce("lines", "content").alias(c) if c == "content" else F.when(F.col("lines").isNull(), F.col(c)).alias(c) if c == "tool_calls" else c for c in messages.columns])


def emergency(messages: DataFrame, key: str, most: int = EMERGENCY) -> DataFrame:
    """Sessions of more characters than that keep their recent messages and one mark before them."""
    sizes = totals(messages, key).select(key, (F.col("chars") > most).alias("over"))
    own = with_recent(messages, key).join(sizes, key)
    kept = own.filter(~F.col("over") | F.col("recent")).select(*messages.columns)
    mark = own.filter("over and not recent").groupBy(key).agg(F.min("turn").alias("turn")).withColumn("role", F.lit("system")).withColumn("content", F.lit("[earlier messages dropped]"))
    return kept.unionByName(mark, allowMissingColumns=True).select(*messages.columns)


def levels(messages: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """key and level: none, emergency, or how far compression goes by user turns. Three failures stop all of it."""
    n = totals(messages, key).join(sessions.select(key, F.coalesce("compact_failures", F.lit(0)).alias("failures")), key, "left")
    turns = F.col("user_turns")
    level = F.when(F.col("failures") >= FAILURES, "none").when(F.col("chars") > EMERGENCY, "emergency").when(turns > AUTO, "auto").when(turns > FOLD, "fold").when(turns > MICRO, "micro").when(turns > SNIP, "snip").otherwise("none")
    return n.select(key, level.alias("level"))


def to_summarise(messages: DataFrame, key: str, each: int = 400, roles: tuple[str, ...] | None = None) -> DataFrame:
    """key and text: what a summary is made of, so many characters of each old message; with ``roles`` of theirs alone, without blank ones."""
    old = with_recent(messages, key).filter("not recent")
    if roles:
        old = old.filter(F.col("role").isin(*roles) & (T.first_text("content") != ""))
    line = F.concat("role", F.lit(": "), F.substring(T.first_text("content"), 1, each))
    return old.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))


def enriched_citations(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Title, authors and year filled in where they are missing; citations of blank text go."""
    p = papers.select(F.col("id").alias("paper_id"), F.col("title").alias("__title"), F.col("authors").alias("__authors"), F.col("year").alias("__year"))
    joined = citations.join(p, "paper_id", "left")
    return joined.select("paper_id", "type", "block_idx", "text", F.coalesce(F.nullif("title", F.lit("")), "__title").alias("title"), F.coalesce("authors", "__authors").alias("authors"), F.coalesce("year", "__year").alias("year")).filter(F.trim("text") != "")


def distinct_citations(citations: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The first of each type, paper and block (or, without a block, first 60 characters)."""
    place = F.coalesce(F.col("block_idx").cast("string"), F.substring(T.first_text("text"), 1, 60))
    rank = F.row_number().over(W.partitionBy(key, "type", "paper_id", place).orderBy(pos))
    return citations.withColumn("__k", rank).filter("__k = 1").drop("__k")


def grouped_citations(citations: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a paper, in the order of first mention, with its label and the places cited; places of one position by block, none first."""
    g = citations.groupBy(key, "paper_id").agg(F.min(pos).alias("first"), F.min_by("authors", pos).alias("authors"), F.array_sort(F.collect_list(F.struct(pos, "block_idx"))).alias("items"))
    return g.select(key, "paper_id", "first", T.author_label(F.col("authors")).alias("label"), F.array_join(F.transform("items", lambda i: F.coalesce(i["block_idx"].cast("string"), F.lit("-"))), ",").alias("places"))


def cited_references(texts: DataFrame, references: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, number and reference of every mark [n] in a text that a reference (key, pos, reference) answers."""
    marks = texts.select(key, F.explode(T.citation_numbers(F.col(text))).alias("number")).distinct()
    return marks.join(references.withColumn("number", F.col("pos") + 1), [key, "number"]).select(key, "number", "reference")


def broken(calls: DataFrame, key: str, tool: str = "query_database", failures: int = FAILURES) -> DataFrame:
    """key and turn of the call with which a tool is taken away: the first that ends ``failures`` failures of it in a row. calls: key, turn, tool, and failed."""
    own = W.partitionBy(key).orderBy("turn")
    counted = calls.filter(F.col("tool") == tool).withColumn("__good", F.count_if(~F.col("failed")).over(own))
    in_row = F.count_if(F.col("failed")).over(W.partitionBy(key, "__good").orderBy("turn"))
    return counted.withColumn("__n", in_row).filter((F.col("__n") >= failures) & F.col("failed")).groupBy(key).agg(F.min("turn").alias("turn"))


def with_summary(messages: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Recent messages of sessions that have a summary (key, summary), after one system message that holds it; other sessions as they are."""
    own = with_recent(messages, key).join(summaries.select(key, "summary"), key, "left")
    kept = own.filter(F.col("summary").isNull() | F.col("recent")).select(*messages.columns)
    told = own.filter("summary is not null and not recent").groupBy(key).agg(F.min("turn").alias("turn"), F.first("summary").alias("summary"))
    mark = told.select(key, "turn", F.lit("system").alias("role"), F.concat(F.lit(SUMMARY), F.lit("\n"), "summary").alias("content"))
    return kept.unionByName(mark, allowMissingColumns=True).select(*messages.columns)

"""Operators over the ordered blocks of documents: markdown to blocks, outlines, scopes and neighbours.

Blocks are rows with a key column, ``idx`` (the position), ``level`` (0 for paragraphs, 1 to 3 for headings), ``text`` and, where a table has it,
``image_url``. Windows are per document, so that work spreads over documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, idx and line of every line."""
    return docs.select(key, F.posexplode(F.split(text, r"\R")).alias("idx", "line"))


def classified(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, idx, type (heading, paragraph, image), level, text and url of every line that isn't blank."""
    own = lines(docs, key, text).withColumn("line", F.trim("line")).filter("line <> ''")
    line = F.col("line")
    level, image = T.heading_level(line), T.is_image_line(line)
    kind = F.when(image, "image").when(level > 0, "heading").otherwise("paragraph")
    return own.select(key, "idx", kind.alias("type"), F.when(image, 0).otherwise(level).alias("level"), F.when(image, F.lit(None)).when(level > 0, T.heading_text(line)).otherwise(line).alias("text"), F.when(image, T.image_url(line)).alias("url"))


def chunk_numbers(words: pd.Series, heads: pd.Series, most: int) -> pd.Series:
    """The chunk of every line, by the numbers of words and whether lines are headings. One pass; a built-in fold would copy its list for every line."""
    out = []
    for n, head in zip(words, heads):
        chunk, total, own = 0, 0, []
        for i, (w, h) in enumerate(zip(n, head)):
            if i and (h or total + w > most):
                chunk, total = chunk + 1, 0
            total += int(w)
            own.append(chunk)
        out.append(own)
    return pd.Series(out)


def chunks(docs: DataFrame, key: str, text: str = "text", max_words: int = 1500) -> DataFrame:
    """key, chunk and text: greedy chunks of whole lines.

    A heading begins a chunk, and so does a line that would bring one over ``max_words`` words; a longer line stays whole. Blank chunks go.
    Only counts and flags of lines go to Python.
    """

    def number(words: pd.Series, heads: pd.Series) -> pd.Series:
        return chunk_numbers(words, heads, max_words)

    own = docs.select(key, F.split(text, r"\R").alias("__lines"))
    words = F.transform("__lines", lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    heads = F.transform("__lines", lambda x: F.rlike(x, F.lit(r"^#{1,6}\s")))
    placed = own.filter("__lines is not null").withColumn("__at", F.pandas_udf(number, "array<int>")(words, heads))
    rows = placed.select(key, F.posexplode(F.arrays_zip("__lines", "__at")).alias("idx", "x")).select(key, "idx", F.col("x.__lines").alias("line"), F.col("x.__at").alias("chunk"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda s: s["line"]), "\n")
    whole = rows.groupBy(key, "chunk").agg(joined.alias("text")).filter(F.trim(F.regexp_replace("text", r"\s+", "")) != "")
    return whole.select(key, (F.row_number().over(W.partitionBy(key).orderBy("chunk")) - 1).alias("chunk"), "text")


def heading_context(blocks: DataFrame, key: str, name: Column | None = None) -> DataFrame:
    """The blocks with ``context``: the text of the nearest heading strictly before each, else ''."""
    heading = F.when(F.col("level") >= 1, T.first_text("text") if name is None else name)
    before = W.partitionBy(key).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("context", F.coalesce(F.last(heading, ignorenulls=True).over(before), F.lit("")))


def outline(blocks: DataFrame, key: str) -> DataFrame:
    return blocks.filter("level >= 1").select(key, "idx", "level", "text")


def section_ends(blocks: DataFrame, key: str) -> DataFrame:
    """key, start_index, end_index, level and heading: each section up to the next heading of any level."""
    sizes = blocks.groupBy(key).agg((F.max("idx") + 1).alias("n"))
    heads = outline(blocks, key).withColumn("next", F.lead("idx").over(W.partitionBy(key).orderBy("idx")))
    return heads.join(sizes, key).select(key, F.col("idx").alias("start_index"), (F.coalesce("next", "n") - 1).alias("end_index"), "level", F.col("text").alias("heading"))


def outline_paths(blocks: DataFrame, key: str) -> DataFrame:
    """key, idx, level, heading and path: a stack of headings cut to level - 1 before each is pushed; empty ones don't show.

    An ordered fold per document over its headings alone.
    """
    heads = outline(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "level", F.trim("text").alias("text")))).alias("__h"))
    fold = """aggregate(__h, named_struct('stack', cast(array() as array<string>), 'out', cast(array() as array<struct<idx:int,level:int,text:string,path:string>>)),
        (a, x) -> named_struct('stack', concat(slice(a.stack, 1, greatest(x.level - 1, 0)), array(x.text)),
            'out', concat(a.out, array(named_struct('idx', cast(x.idx as int), 'level', x.level, 'text', x.text,
                'path', array_join(filter(concat(slice(a.stack, 1, greatest(x.level - 1, 0)), array(x.text)), s -> s <> ''), ' > '))))),
        a -> a.out)"""
    return heads.select(key, F.inline(F.expr(fold))).select(key, F.col("idx"), "level", F.col("text").alias("heading"), "path")


def section_scope(blocks: DataFrame, key: str, heading: str, start: int = 0) -> DataFrame:
    """Blocks from each document's first heading at ``start`` or later that contains ``heading`` up to the next one of its level or above; none where it is missing."""
    low = F.lower(F.coalesce("text", F.lit("")))
    starts = blocks.filter((F.col("level") >= 1) & (F.col("idx") >= start) & F.contains(low, F.lit(heading.lower()))).groupBy(key).agg(F.min(F.struct("idx", "level")).alias("__s"))
    inside = blocks.join(starts, key).filter(F.col("idx") >= F.col("__s.idx"))
    stop = F.min(F.when((F.col("level") >= 1) & (F.col("level") <= F.col("__s.level")) & (F.col("idx") > F.col("__s.idx")), F.col("idx"))).over(W.partitionBy(key))
    return inside.withColumn("__stop", stop).filter(F.col("__stop").isNull() | (F.col("idx") < F.col("__stop"))).drop("__s", "__stop")


def scoped(blocks: DataFrame, key: str, heading: str | None) -> DataFrame:
    """The section, and whole documents that lack it."""
    if not heading:
        return blocks
    own = section_scope(blocks, key, heading)
    return own.unionByName(blocks.join(own.select(key).distinct(), key, "left_anti"))


def section_text(blocks: DataFrame, key: str, heading: str, offset: int = 0, page: int = 50) -> DataFrame:
    """key, paragraph_count, has_more and content of one page of each document's section: no headings' own row, images or empty blocks."""
    own = section_scope(blocks, key, heading)
    first = F.min("idx").over(W.partitionBy(key))
    kept = own.withColumn("__first", first).filter((F.col("idx") > F.col("__first")) & (T.first_text("text") != "") & F.col("image_url").isNull())
    rows = kept.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy("idx"))).withColumn("__total", F.count("*").over(W.partitionBy(key)))
    shown = rows.filter((F.col("__k") > offset) & (F.col("__k") <= offset + page))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "\n")
    return shown.groupBy(key).agg(F.first("__total").alias("paragraph_count"), (F.first("__total") > offset + page).alias("has_more"), body.alias("content"))


def paragraph_context(blocks: DataFrame, key: str, targets: DataFrame, window: int = 2) -> DataFrame:
    """Blocks at most ``window`` positions from each target (key, target), images left out, with is_target and the heading context.

    Each target names its 2 * window + 1 positions, so the join is on equal keys.
    """
    near = targets.select(key, "target", F.explode(F.sequence(F.col("target") - window, F.col("target") + window)).alias("idx"))
    framed = heading_context(blocks, key)
    return near.join(framed, [key, "idx"]).filter(F.col("image_url").isNull()).select(key, "target", "idx", "text", "context", (F.col("idx") == F.col("target")).alias("is_target"))


def section_snippets(blocks: DataFrame, key: str, most: int = 4, limit: int = 260) -> DataFrame:
    """key, start_index, nth and snippet: the first paragraphs of each section, clipped."""
    start = F.last(F.when(F.col("level") >= 1, F.col("idx")), ignorenulls=True).over(W.partitionBy(key).orderBy("idx"))
    rows = blocks.withColumn("start_index", start).filter((F.col("level") == 0) & (T.first_text(F.trim("text")) != "") & F.col("start_index").isNotNull())
    nth = F.row_number().over(W.partitionBy(key, "start_index").orderBy("idx"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select(key, "start_index", "nth", T.clip(F.col("text"), limit).alias("snippet"))


def reading_view(blocks: DataFrame) -> DataFrame:
    """Without headings of the reference list; positions stay."""
    shown = F.rlike(F.trim(F.coalesce("text", F.lit(""))), F.lit(r"(?i)^(参考文献|references|bibliography)\s*$"))
    return blocks.filter(~(F.col("level").isNotNull() & shown))


def export_rows(blocks: DataFrame, key: str, mode: str) -> DataFrame:
    """key, idx, part, heading and content of an export: original, translation, or both (the original first; a second image only if it differs)."""
    original, translated = F.struct(F.lit(0).alias("part"), T.first_text("text", "image_url").alias("content")), F.struct(F.lit(1).alias("part"), T.first_text("text_zh", "image_url_zh", "image_url").alias("content"))
    parts = {"original": F.array(original), "translation": F.array(translated), "both": F.array(original, translated)}[mode]
    rows = blocks.select(key, "idx", (F.col("level") >= 1).alias("heading"), "image_url", F.explode(parts).alias("p"))
    same = (F.col("image_url").isNotNull() & (F.col("p.part") == 1) & (F.col("p.content") == F.col("image_url"))) if mode == "both" else F.lit(False)
    return rows.filter(~same & (F.col("p.content") != "")).select(key, "idx", F.col("p.part").alias("part"), "heading", F.col("p.content").alias("content"))


def replaced_lines(docs: DataFrame, key: str, changes: DataFrame, text: str = "text") -> DataFrame:
    """Documents with whole lines replaced: ``changes`` has key, old, new and pos; the first change of a line wins, and '' deletes it."""
    first = changes.groupBy(key, "old").agg(F.min_by("new", "pos").alias("new"))
    rows = lines(docs, key, text)
    joined = rows.join(first, (rows[key] == first[key]) & (rows["line"] == first["old"]), "left").select(rows[key], "idx", F.coalesce("new", "line").alias("line"), F.col("new").alias("made"))
    kept = joined.filter(F.col("made").isNull() | (F.col("made") != ""))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda s: s["line"]), "\n").alias(text))


def with_masked_images(docs: DataFrame, text: str = "text") -> DataFrame:
    """Image lines replaced by numbered placeholders (column ``masked``), and the map that turns them back (``images``)."""
    own = docs.withColumn("__l", F.split(text, r"\R")).withColumn("__at", F.filter(F.transform("__l", lambda x, i: F.when(F.startswith(F.trim(x), F.lit("![")), i)), lambda i: i.isNotNull()))
    mark = lambda i: F.concat(F.lit("[[IMG_"), F.array_position(F.col("__at"), i) - 1, F.lit("]]"))
    masked = F.array_join(F.transform("__l", lambda x, i: F.when(F.array_contains("__at", i), mark(i)).otherwise(x)), "\n")
    images = F.map_from_arrays(F.transform("__at", lambda i: mark(i)), F.transform("__at", lambda i: F.trim(F.get("__l", i))))
    return own.withColumn("masked", masked).withColumn("images", images).drop("__l", "__at")


def unmasked(rows: DataFrame, line: str, images: str) -> DataFrame:
    return rows.withColumn(line, F.coalesce(F.element_at(images, F.trim(line)), F.col(line)))


def with_verdicts(blocks: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Paragraphs that ``verdicts`` (key, idx, is_reference) names become references."""
    named = verdicts.filter("is_reference").select(key, "idx", F.lit(True).alias("__ref"))
    joined = blocks.join(named, [key, "idx"], "left")
    return joined.withColumn("type", F.when(F.col("__ref") & (F.col("type") == "paragraph"), "reference").otherwise(F.col("type"))).drop("__ref")


def with_element(results: DataFrame, position: int, url: str) -> DataFrame:
    """An array column ``body`` of blocks with the translated image of one position set."""
    return results.withColumn("body", F.transform("body", lambda b, i: F.when(i == position, b.withField("image_url_zh", F.lit(url))).otherwise(b)))


def type_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("type").agg(F.count("*").alias("n"))

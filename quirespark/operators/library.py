"""The library of papers: filters, paging, folders, and changes as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..stored import stored
from . import closure


def library_filter(papers: DataFrame, query: str = "", year: int | None = None, paper_type: str | None = None, wildcards: bool = False) -> DataFrame:
    """No chapters; the query is part of either title; empty arguments don't filter. ``wildcards``: % and _ of the query are live."""
    rows = papers.filter("document_role <> 'long_chapter'")
    if query:
        hit = (lambda c: F.ilike(c, F.lit(f"%{query}%"))) if wildcards else (lambda c: F.contains(F.lower(c), F.lit(query.lower())))
        rows = rows.filter(hit("title") | F.coalesce(hit("title_zh"), F.lit(False)))
    if year:
        rows = rows.filter(F.col("year") == year)
    return rows.filter(F.col("paper_type") == paper_type) if paper_type else rows


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The ``number``-th page, from 1, of at most 100 rows each."""
    size = min(size, 100)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def of_domain(terms: DataFrame, domain: str | None = None) -> DataFrame:
    """Terms of a domain; without one, all of them."""
    return terms.filter(F.col("domain") == domain) if domain else terms


def top_level(jobs: DataFrame) -> DataFrame:
    """Jobs that are no chapter of another."""
    return jobs.filter("parent_job_id is null")


def with_papers(results: DataFrame, papers: DataFrame) -> DataFrame:
    """All results, not only the latest, with title and year of their papers; results without a paper go."""
    return results.join(papers.select(F.col("id").alias("paper_id"), "title", "year"), "paper_id")


def chapters_with_state(papers: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Chapters with their first job (by id) and latest result, where they have them; without a job a chapter is pending."""
    own = papers.filter("document_role = 'long_chapter'").select("parent_paper_id", F.col("id").alias("paper_id"), "chapter_index", "chapter_title")
    job = first_of(jobs.select("paper_id", F.col("id").alias("job_id"), "status", "progress", "current_stage"), ["paper_id"], "job_id")
    newest = latest(results.select("paper_id", F.col("id").alias("result_id"), "created_at"), "paper_id", "created_at", "result_id").select("paper_id", "result_id")
    found = own.join(job, "paper_id", "left").join(newest, "paper_id", "left")
    return found.withColumns({"status": F.coalesce("status", F.lit("pending")), "progress": F.coalesce("progress", F.lit(0)), "current_stage": T.first_text("current_stage")})


def in_folder(papers: DataFrame, mapping: DataFrame, folder_id: int, key: str = "id") -> DataFrame:
    return papers.join(mapping.filter(F.col("folder_id") == folder_id).select(F.col("paper_id").alias(key)), key, "left_semi")


def unclassified(papers: DataFrame, mapping: DataFrame, key: str = "id") -> DataFrame:
    return papers.join(mapping.select(F.col("paper_id").alias(key)), key, "left_anti")


def folder_counts(folders: DataFrame, mapping: DataFrame) -> DataFrame:
    """Folders with the number of papers mapped to them directly, parents first."""
    n = mapping.groupBy("folder_id").agg(F.count("*").alias("paper_count"))
    return folders.join(n, folders.id == n.folder_id, "left").select("id", "name", "parent_id", F.coalesce("paper_count", F.lit(0)).alias("paper_count")).orderBy(F.asc_nulls_first("parent_id"), "name")


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """id and depth (from 1) of a folder and all below it, however deep, each once."""
    return closure.below(folders, root)


def folder_levels(folders: DataFrame) -> DataFrame:
    """id, top, depth and circular of every folder; a folder may be added below those of a depth under 3 (``may_hold``)."""
    return closure.levels(folders).withColumn("may_hold", F.coalesce(F.col("depth") < 3, F.lit(False)))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; the last column breaks ties."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("__k = 1").drop("__k")


def first_of(rows: DataFrame, keys: list[str | Column], *order: str) -> DataFrame:
    """The first row of each key by ``order``, with all its columns."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def distinct_terms(terms: DataFrame, term: str, *order: str) -> DataFrame:
    """Of terms that are equal without case, the first."""
    return first_of(terms, [F.lower(term)], *order)


def uploads(files: DataFrame, *order: str) -> DataFrame:
    """The PDF files of a list, those of one name and size once."""
    return first_of(files.filter(F.endswith(F.lower("name"), F.lit(".pdf"))), ["name", "size"], *order)


def term_hint(terms: DataFrame, k: int = 120) -> DataFrame:
    """The first k terms in the order of terms, as a hint of the glossary."""
    return terms.orderBy("en").limit(k)


def recent_sessions(sessions: DataFrame, k: int = 50) -> DataFrame:
    return sessions.orderBy(F.desc("updated_at"), F.desc("id")).limit(k)


def catalog_lines(papers: DataFrame, k: int = 50) -> DataFrame:
    """id and line: title, translated title if another, and what is known of domain, year and journal."""
    known = F.concat_ws(", ", F.nullif("domain", F.lit("")), F.col("year").cast("string"), F.nullif("journal", F.lit("")))
    shown = T.first_text("title_zh", "title")
    line = F.concat(shown, F.when(shown != F.col("title"), F.concat(F.lit(" / "), F.col("title"))).otherwise(""), F.when(known != "", F.concat(F.lit(" ("), known, F.lit(")"))).otherwise(""))
    return papers.orderBy("id").limit(k).select("id", line.alias("line"))


def with_file_url(results: DataFrame, papers: DataFrame) -> DataFrame:
    keys = papers.select(F.col("id").alias("paper_id"), F.concat(F.lit("/uploads/"), "storage_key").alias("pdf_url"))
    return results.join(keys, "paper_id", "left")


def settings(environment: DataFrame, stored: DataFrame) -> DataFrame:
    """key and value: stored values that aren't empty override the environment's."""
    s = stored.select("key", F.col("value").alias("__stored"))
    return environment.join(s, "key", "full_outer").select("key", F.coalesce(F.nullif("__stored", F.lit("")), "value").alias("value"))


def missing_settings(found: DataFrame, required: list[str]) -> DataFrame:
    wanted = found.sparkSession.createDataFrame([(k,) for k in required], "key string")
    return wanted.join(found.filter("value <> ''"), "key", "left_anti")


# --- changes: each returns the table after the change --------------------------------------------------------------------


def without(rows: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return rows.join(gone.select(F.col(other or key).alias(key)).distinct(), key, "left_anti")


def delete_papers(papers: DataFrame, jobs: DataFrame, results: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Papers, jobs and results without the papers in ``ids`` (column id) and their chapters. Annotations and folder mappings stay, as orphans."""
    chapters = papers.join(ids.select(F.col("id").alias("parent_paper_id")), "parent_paper_id", "left_semi").select("id")
    gone = ids.select("id").union(chapters).distinct()
    return without(papers, gone, "id"), without(jobs, gone, "paper_id", "id"), without(results, gone, "paper_id", "id")


def delete_jobs(jobs: DataFrame, results: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and results without the jobs in ``ids`` and their children."""
    own = ids.select("id")
    parents = own.select(F.col("id").alias("parent_job_id"))
    gone = own.union(jobs.join(parents, "parent_job_id", "left_semi").select("id"))
    kept = jobs.join(own, "id", "left_anti").join(parents, "parent_job_id", "left_anti")
    return kept.select(*jobs.columns), results.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti").select(*results.columns)


def delete_by_status(jobs: DataFrame, results: DataFrame, statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """Jobs and results without the top-level jobs in these states and their children."""
    return delete_jobs(jobs, results, top_level(jobs).filter(F.col("status").isin(statuses)).select("id"))


def delete_folder(folders: DataFrame, mapping: DataFrame, papers: DataFrame, root: int, physical: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders and mappings without a subtree; its papers stay unclassified, or go too."""
    gone = subtree(folders, root).select("id")
    held = mapping.join(gone.select(F.col("id").alias("folder_id")), "folder_id", "left_semi").select(F.col("paper_id").alias("id"))
    return without(folders, gone, "id"), without(mapping, gone, "folder_id", "id"), without(papers, held, "id") if physical else papers


def move_papers(mapping: DataFrame, ids: DataFrame, folder_id: int | None) -> DataFrame:
    """Mappings (paper_id, folder_id) with the papers in ``ids`` (paper_id) in one folder, or in none."""
    kept = without(mapping.select("paper_id", "folder_id"), ids, "paper_id")
    return kept if folder_id is None else kept.unionByName(ids.select("paper_id").distinct().withColumn("folder_id", F.lit(folder_id).cast(mapping.schema["folder_id"].dataType)))


def restart_failed(jobs: DataFrame, results: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and results after the jobs in ``ids`` are started anew: failed ones are pending again and lose their result.

    Of a parent only the failed children start, and the parent is pending; a parent without failed children stays. The parent of a child that
    starts is pending too, at 99 percent at most, and keeps its result.
    """
    asked = ids.select("id")
    failed = jobs.filter("status = 'failed'").select("id", "parent_job_id")
    parents = jobs.filter("parent_job_id is not null").select(F.col("parent_job_id").alias("id"))
    children = failed.join(asked.select(F.col("id").alias("parent_job_id")), "parent_job_id", "left_semi").select("id", F.col("parent_job_id").alias("up"), F.lit("parent").alias("kind"))
    alone = failed.join(asked, "id", "left_semi").join(parents, "id", "left_anti").select("id", F.col("parent_job_id").alias("up"), F.lit("above").alias("kind"))
    # found once: of what a job is, the one that resets most counts
    each = children.union(alone).select(F.explode(F.array(F.struct("id", F.lit("own").alias("kind")), F.struct(F.col("up").alias("id"), "kind"))).alias("m")).select("m.*").filter("id is not null")
    rank = F.max(F.when(F.col("kind") == "own", 3).when(F.col("kind") == "parent", 2).otherwise(1))
    marks = stored(each.groupBy("id").agg(rank.alias("__rank")), "marks").select("id", F.element_at(F.array(F.lit("above"), F.lit("parent"), F.lit("own")), F.col("__rank")).alias("__as"))
    marked = jobs.join(marks, "id", "left")
    started = F.col("__as").isNotNull()
    fresh = {"status": F.lit("pending"), "progress": F.when(F.col("__as") == "above", F.least(F.coalesce("progress", F.lit(0)), F.lit(99))).otherwise(0) if "progress" in jobs.columns else None, "current_stage": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string"), "pending_terms": F.when(F.col("__as") != "own", F.col("pending_terms")) if "pending_terms" in jobs.columns else None, "completed_at": F.lit(None)}
    reset = marked.withColumns({c: F.when(started, v).otherwise(F.col(c)).cast(jobs.schema[c].dataType) for c, v in fresh.items() if c in jobs.columns})
    dropped = marks.filter("__as <> 'above'").select(F.col("id").alias("job_id"))
    return reset.select(*jobs.columns), results.join(dropped, "job_id", "left_anti").select(*results.columns)


# --- single papers and their parts ---------------------------------------------------------------------------------------


def metadata(papers: DataFrame, key: str, value) -> DataFrame:
    """What is known of one paper; empty strings count as missing."""
    shown = ["title", "title_zh", "authors", "abstract", "abstract_zh", "keywords", "doi", "year", "paper_type", "journal", "division", "domain"]
    texts = {f.name for f in papers.schema if f.dataType.simpleString() == "string"}
    return papers.filter(F.col(key) == value).limit(1).select(key, *[F.nullif(c, F.lit("")).alias(c) if c in texts else c for c in shown if c in papers.columns])


def of_latest_result(rows: DataFrame, results: DataFrame, paper: str = "paper_id", result: str = "result_id") -> DataFrame:
    """Rows (annotations, references, blocks) that belong to the latest result of each paper."""
    newest = latest(results.select(paper, F.col("id").alias(result), "created_at"), paper, "created_at", result).select(paper, result)
    return rows.drop(paper).join(newest, result)


def pending_terms(jobs: DataFrame) -> DataFrame:
    """id, en and zh of terms that await review, from the JSON text of jobs in that state."""
    terms = F.from_json("pending_terms", "array<struct<en:string,zh:string>>")
    return jobs.filter("status = 'waiting_term_review'").select("id", F.inline(terms))


def snapshot_terms(terms: DataFrame, key: str) -> DataFrame:
    """One row a job with its glossary as it is now: an array of (en, zh, status) in the order of terms."""
    return terms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("en", "zh", "status"))).alias("glossary"))


def changed_row(rows: DataFrame, key: str, value, **columns) -> DataFrame:
    """One row with other values in some columns: terms, folder names, annotations, the operation log."""
    hit = F.col(key) == value
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()})


def added_row(rows: DataFrame, **columns) -> DataFrame:
    """The table with one row more; columns that aren't given are null."""
    new = rows.sparkSession.range(1).select(*[F.lit(columns.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    return rows.unionByName(new)


def without_row(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(~F.col(key).eqNullSafe(F.lit(value)))


def image_work(images: DataFrame, key: str, translations: str = "translations") -> DataFrame:
    """key, text and new text of image texts to replace: not those that are never translated, nor those that stay as they are."""
    each = images.select(key, F.explode(translations).alias("text", "t"))
    return each.filter((F.col("t.action") != "never_translate") & (F.col("t.translated") != F.col("text"))).select(key, "text", F.col("t.translated").alias("translated"))

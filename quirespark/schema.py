"""Schemas of the library's tables, and the table of blocks that documents become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAPERS = "id string, title string, title_zh string, authors array<string>, abstract string, abstract_zh string, keywords array<string>, doi string, year int, paper_type string, journal string, division string, source_language string, domain string, document_role string, parent_paper_id string, chapter_index int, chapter_title string, start_page int, end_page int, storage_key string, file_size bigint, page_count int, created_at timestamp_ntz"
RESULTS = "id string, job_id string, paper_id string, structure_json string, created_at timestamp_ntz"
JOBS = "id string, paper_id string, parent_job_id string, chapter_index int, total_chapters int, job_type string, status string, current_stage string, progress int, error_message string, translate_images boolean, pending_terms string, created_at timestamp_ntz, completed_at timestamp_ntz"
ANNOTATIONS = "id string, result_id string, scope string, content string, block_id string, start_offset int, end_offset int, selected_text string, created_at timestamp_ntz"
GLOSSARY = "id string, foreign_term string, zh_term string, source_language string, domain string, status string, updated_at timestamp_ntz"
DOMAIN_GLOSSARY = "id string, domain string, en_term string, zh_term string, created_at timestamp_ntz"
FOLDERS = "id int, name string, parent_id int, created_at timestamp_ntz"
PAPER_FOLDER = "id int, paper_id string, folder_id int"
CHAT_SESSIONS = "id string, title string, history_json string, compaction_summary string, auto_summary string, compact_failures int, created_at timestamp_ntz, updated_at timestamp_ntz"
CHAT_MESSAGES = "id string, session_id string, role string, content string, tool_calls_json string, citations_json string, created_at timestamp_ntz"
BODY = "array<struct<`标题等级`:int,`文本`:string,`中文文本`:string,`图片地址`:string,`中文图片地址`:string>>"
STRUCTURE = f"struct<`标题`:string,`标题中文`:string,`年份`:string,`DOI`:string,`正文`:{BODY},`参考文献`:array<string>>"


def blocks(results: DataFrame) -> DataFrame:
    """result_id, paper_id, block_idx, level, text_en, text_zh, image_url, image_url_zh and created_at of all blocks of results with a structure_json."""
    body = results.select(F.col("id").alias("result_id"), "paper_id", "created_at", F.posexplode(F.from_json("structure_json", STRUCTURE)["正文"]).alias("block_idx", "b"))
    names = {"text_en": "文本", "text_zh": "中文文本", "image_url": "图片地址", "image_url_zh": "中文图片地址"}
    return body.select("result_id", "paper_id", "created_at", "block_idx", F.coalesce(F.col("b")["标题等级"], F.lit(0)).alias("level"), *[F.col("b")[zh].alias(en) for en, zh in names.items()])


def references(results: DataFrame) -> DataFrame:
    """result_id, paper_id, pos and text of all references, in order."""
    return results.select(F.col("id").alias("result_id"), "paper_id", F.posexplode(F.from_json("structure_json", STRUCTURE)["参考文献"]).alias("pos", "text"))

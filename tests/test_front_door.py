from __future__ import annotations

import json

import pytest

from quirespark import schema
from quirespark.plans import front_door, operations


def library(spark, heads: int = 3, paper: str = "p") -> dict:
    body = [{"标题等级": 1 if i % 2 == 0 else 0, "文本": f"{paper} head {i}" if i % 2 == 0 else f"tide text {i}", "中文文本": "", "图片地址": ""} for i in range(2 * heads)]
    structure = json.dumps({"标题": "T", "标题中文": "", "年份": "2020", "正文": body, "参考文献": ["[1] A"]}, ensure_ascii=False)
    empty = lambda s: spark.createDataFrame([], s)
    return {
        "papers": spark.createDataFrame([(paper, "Title", "a tide")], "id string, title string, abstract_zh string"),
        "results": spark.createDataFrame([("old", "j", paper, "{}", None), ("r", "j", paper, structure, None)], schema.RESULTS).selectExpr("id", "job_id", "paper_id", "structure_json", "cast(if(id = 'r', '2021-01-01', '2020-01-01') as timestamp_ntz) as created_at"),
        "annotations": spark.createDataFrame([("a1", "r", "block", "about the tide", "b1", 0, 1, "", None), ("a2", "r", "paper", "nothing", None, 0, 1, "x", None), ("a3", "old", "paper", "tide", None, 0, 1, "", None)], schema.ANNOTATIONS),
        "sessions": empty(schema.CHAT_SESSIONS), "messages": empty(schema.CHAT_MESSAGES),
    }


def test_arguments_and_fields(spark):
    ops = operations.library_operations(spark, library(spark))
    r = ops.call(spark, "search_in_paper", paper_id="p", query="tide", section=None, limit=2).first()
    assert [(m.block_idx, m.heading_context, m.score) for m in r.matches] == [(1, "p head 0", 1), (3, "p head 2", 1)] and [a.content for a in r.annotations] == ["about the tide"] and r.annotation_note
    r = ops.call(spark, "search_in_paper", paper_id="p", query="absent").first()
    assert r.matches is None and r.annotations is None and r.annotation_note is None
    r = ops.call(spark, "get_paper_section", paper_id="p", heading="HEAD 2").first()
    assert (r.section_heading, r.content_en, r.paragraph_count, r.has_more) == ("p head 2", "tide text 3", 1, False)
    r = ops.call(spark, "get_paper_section", paper_id="p", heading="none").first()
    assert "none" in r.error and r.available_headings == ["p head 0", "p head 2", "p head 4"]
    found = ops.call(spark, "search_papers", query="tide")
    assert found.columns == ["paper_id", "title", "title_zh", "year", "domain", "journal", "abstract_snippet"] and found.first().abstract_snippet == "a tide"
    r = ops.call(spark, "get_paper_outline", paper_id="p").first()
    assert (r.paper.title, r.paper.year) == ("T", "2020") and [h.heading_en for h in r.outline] == ["p head 0", "p head 2", "p head 4"]
    assert {r.content for r in ops.call(spark, "get_annotations", paper_id="p").collect()} == {"about the tide", "nothing"}
    assert "block_idx 9" in ops.call(spark, "get_paragraph_context", paper_id="p", block_idx=9).first().error
    for wrong in ({"paper_id": "p", "word": "x"}, {"paper_id": "q", "query": "x"}):
        assert ops.call(spark, "search_in_paper", **wrong).columns == ["error"]


def test_long_answers_are_whole(spark):
    ops = operations.library_operations(spark, library(spark, heads=1200))
    assert len(ops.call(spark, "get_paper_outline", paper_id="p").first().outline) == 1200
    many = front_door.Operations(rows=lambda: spark.range(3000), late=lambda: spark.sql("select raise_error('late')"))
    assert many.call(spark, "rows").count() == 3000 and "late" in many.call(spark, "late").first().error


def test_libraries_keep_their_tables_apart(spark):
    spark.range(5).createOrReplaceTempView("papers")
    one, two = library(spark, paper="one"), library(spark, paper="two")
    a = front_door.query(spark, "select id from papers", one)
    b = front_door.query(spark, "select id from papers", two)
    assert [r.id for r in a.collect()] == ["one"] and [r.id for r in b.collect()] == ["two"]
    assert spark.table("papers").count() == 5 and not spark.catalog.tableExists("annotations")
    spark.catalog.dropTempView("papers")
    with pytest.raises(Exception, match="structure_json"):
        front_door.query(spark, "select structure_json from results", one)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_functions(spark):
    rows = spark.createDataFrame([("a", '{"x": [1, 2], "y": "z"}', "2024-02-29 07:08:09"), ("b", "[3]", "no date"), ("b", None, None)], "k string, doc string, at string")
    ask = lambda s, **how: [tuple(r) for r in front_door.query(spark, s, {"t": rows}, **how).collect()]
    assert ask("select strftime('%Y/%j %H:%M:%S %w', at) from t order by k, at desc") == [("2024/060 07:08:09 4",), (None,), (None,)]
    assert ask("select k, j.key, j.value from t, lateral json_each(doc) j order by 1, 2") == [("a", "x", "[1,2]"), ("a", "y", "z"), ("b", "0", "3")]
    assert ask("select json_extract(doc, '$.x[1]') from t where k = 'a'") == [("2",)]
    assert ask("select k, group_concat(k), group_concat(k, '-') from t group by k order by k") == [("a", "a", "a"), ("b", "b,b", "b-b")]
    assert ask("select count(*) from t where k like 'A%'") == [(0,)] and ask("select count(*) from t where k like 'A%'", nocase=True) == [(1,)]
    assert ask("select cast('12x' as int), 7 div 2, 7 / 2") == [(None, 3, 3.5)]

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirespark.operators import blocks as B
from quirespark.operators import bodies as Y
from quirespark.operators import search as S

BODY = "k int, body array<struct<level:int,text:string,image_url:string>>"


def tables(spark):
    rng = random.Random(6)
    block = lambda: (rng.choice([0, 0, 0, 1, 2, 3, None]), rng.choice([None, "", "on the tide", "and the rest", "On top"]), rng.choice([None, None, "i.png"]))
    docs = [(i, [block() for _ in range(rng.randint(0, 14))]) for i in range(80)] + [(100, []), (101, None), (102, [(1, "on", None)])]
    df = spark.createDataFrame(docs, BODY)
    return df, df.select("k", F.posexplode("body").alias("idx", "b")).select("k", "idx", "b.*")


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(repr, map(tuple, a.select(cols).collect()))) == sorted(map(repr, map(tuple, b.select(cols).collect())))


def test_same_as_over_blocks(spark):
    docs, blocks = tables(spark)
    same(Y.heading_context(docs, "k"), B.heading_context(blocks, "k"))
    same(Y.section_ends(docs, "k"), B.section_ends(blocks, "k"))
    same(Y.section_scope(docs, "k", "ON"), B.section_scope(blocks, "k", "ON"))
    same(Y.scoped(docs, "k", "and"), B.scoped(B.heading_context(blocks, "k"), "k", "and"))
    for offset, page in ((0, 50), (1, 2), (3, 1)):
        same(Y.section_text(docs, "k", "on", offset, page), B.section_text(blocks, "k", "on", offset, page))
    same(Y.paragraph_context(docs, "k", F.lit(3), 2), B.paragraph_context(blocks, "k", docs.select("k", F.lit(3).alias("target")), 2))
    same(S.search_bodies(docs, "k", "the tide", "on", 30).select("k", "idx", "score", "context"), S.search_document(blocks, "k", "the tide", "on", 30).select("k", "idx", "score", "context"))


def test_nothing_is_shuffled(spark, capsys):
    docs, _ = tables(spark)
    for df in (Y.heading_context(docs, "k"), Y.section_ends(docs, "k"), Y.section_text(docs, "k", "on"), Y.scoped(docs, "k", "on")):
        df.explain()
        assert "Exchange" not in capsys.readouterr().out

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quirespark import models


class Chance:
    """Answers by chance, and writes down what it was asked."""

    def __init__(self, log: str):
        self.log = log

    def ask(self, task: str, text: str, hint: str = "") -> str:
        with open(self.log, "a") as f:
            f.write(json.dumps([task, text, hint]) + "\n")
        if random.random() < 0.4:
            raise ValueError("refused")
        return json.dumps([{"type": "paragraph", "text": f"own {random.random()}"}]) if task == "structure" else f"{random.random()} {text}"

    def asked(self) -> list:
        with open(self.log) as f:
            return [json.loads(x) for x in f]


def test_a_chunk_has_blocks_of_one_kind_however_the_client_answers(spark, tmp_path):
    client = Chance(str(tmp_path / "log"))
    chunks = spark.range(200).select(F.col("id").alias("k"), F.concat(F.lit("line "), F.col("id") % 150, F.lit("\nnext")).alias("text"))
    found = models.structured(chunks, "k", client)
    kinds = found.groupBy("k").agg(F.collect_set(F.startswith("text", F.lit("own"))).alias("kinds"), F.count("*").alias("n")).collect()
    assert len(kinds) == 200 and all(len(r.kinds) == 1 and r.n == (1 if r.kinds[0] else 2) for r in kinds)
    assert {len(r.kinds) for r in kinds} == {1} and {r.kinds[0] for r in kinds} == {True, False}
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)
    asked = client.asked()
    assert len(asked) == 150 == len({a[1] for a in asked})


def test_answers_are_kept_and_failures_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 30}", "g" if i % 2 else "") for i in range(120)] + [(500, None, None)], "k int, text string, hint string")
    store = models.Answers(str(tmp_path / "answers"))
    one, two = Chance(str(tmp_path / "one")), Chance(str(tmp_path / "two"))
    first = {r.k: r.translation for r in models.translate(rows, ["k"], one, hints=("hint",), store=store).collect()}
    assert len(one.asked()) == 31  # 30 texts, each with one hint, and the empty one
    again = models.Answers(str(tmp_path / "answers"))
    second = {r.k: r.translation for r in models.translate(rows, ["k"], two, hints=("hint",), store=again).collect()}
    failed = {k for k, v in first.items() if v == ""}
    assert failed and {k for k in first if first[k] != second[k]} <= failed
    assert len(two.asked()) == len({(rows_k % 30, rows_k % 2) for rows_k in failed if rows_k < 500}) + (500 in failed)
    assert all(len({first[k] for k in first if k % 30 == i and k < 500}) == 1 for i in range(30))


def test_passing_errors_are_tried_again_after_a_while(monkeypatch):
    slept = []
    monkeypatch.setattr(time, "sleep", slept.append)

    class Late:
        def __init__(self, error, after):
            self.error, self.left = error, after

        def ask(self, task, text, hint=""):
            if self.left:
                self.left -= 1
                raise self.error
            return "yes"

    assert models.tried(Late(OSError(), 2), "clean", "t", "no") == "yes" and slept == [2, 4]
    slept.clear()
    assert models.tried(Late(OSError(), 3), "clean", "t", "no") == "no" and slept == [2, 4]
    slept.clear()
    assert models.tried(Late(TimeoutError(), 3), "clean", "t", "no", patience=models.Patience(5)) == "yes" and slept == [2, 4, 8]
    slept.clear()
    assert models.tried(Late(KeyError(), 1), "clean", "t", "no") == "no" and not slept


def test_images_and_references(spark):
    class Types:
        def ask(self, task, text, hint=""):
            assert "![" not in text
            return json.dumps([{"type": "image", "placeholder": "__IMG_1__"}, {"type": "reference", "text": "[12] A. Bee. Title."}, {"type": "image", "placeholder": "gone"}, "odd", {"type": "heading", "level": 2, "text": "H"}])

    docs = spark.createDataFrame([(1, "![a](x/1.png)\nwords\n  ![b](x/2.png)\n[12] A. Bee. Title."), (2, None)], "k int, text string")
    rows = [tuple(r)[1:] for r in models.structured(docs, "k", Types()).filter("k = 1").orderBy("idx").collect()]
    assert rows == [(0, "image", 0, None, "x/2.png"), (1, "reference", 0, "A. Bee. Title.", None), (2, "image", 0, None, "gone"), (3, "heading", 2, "H", None)]


def test_many_at_once(spark):
    class Many:
        def ask(self, task, text, hint=""):
            raise AssertionError("one by one")

        def ask_many(self, task, asked):
            return [models.FAILED if t == "b" else t + h for t, h in asked]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, text string")
    assert {r.k: r.translation for r in models.translate(rows, ["k"], Many()).collect()} == {1: "a", 2: "", 3: "a"}


@pytest.mark.parametrize("stage", [models.clean, models.translate, models.titles, models.terms, models.verdicts])
def test_empty_tables(spark, stage):
    key = "title" if stage is models.titles else "text"
    assert stage(spark.createDataFrame([], f"k int, {key} string"), ["k"], models.Stub()).count() == 0

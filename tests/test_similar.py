from __future__ import annotations

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.operators import similar

TEXT = st.text(alphabet="aab cdé中", min_size=1, max_size=14)


def ratio(asked: str, plain: str) -> float:
    return difflib.SequenceMatcher(None, asked, plain).ratio()


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.sampled_from([0.3, 0.6, 0.9, 1.0]), st.dictionaries(st.tuples(st.sampled_from("abc "), st.integers(0, 2)), st.integers(0, 9)))
def test_similar_texts_share_a_mark_whatever_the_order(a, b, least, often):
    if max(ratio(a, b), ratio(b, a)) >= least:
        x, y = similar.prefix(a, least, often), similar.prefix(b, least, often)
        shared = [m for m in x if m in y]
        assert shared
        # what is left behind the first one that they share is enough
        left = min(len(a) - x.index(shared[0]) - 1, len(b) - y.index(shared[0]) - 1)
        assert 1 + left >= least * (len(a) + len(b)) / 2 - 1e-9


def frames(spark, texts, queries):
    return spark.createDataFrame([(t,) for t in texts], "plain string"), spark.createDataFrame([(t,) for t in queries], "asked string")


@pytest.mark.parametrize("sizes", [(3, 5), (1000, 8000)])
def test_against_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(similar, "QUERIES", sizes[0])
    monkeypatch.setattr(similar, "TEXTS", sizes[1])
    rng = random.Random(4)
    words = "red blue tide harbour wind the of a 海 水 lamp lamps".split()
    texts = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)} | {"x", "aaaa", "ü" * 40})
    queries = [*texts[::9], "tide tide", "no such thing at all", "x", "aaab"]
    queries = list(dict.fromkeys(queries))
    for least in (0.6, 0.85):
        got = sorted(map(tuple, similar.similar_texts(*frames(spark, texts, queries), least).collect()))
        assert got == sorted((a, p, ratio(a, p)) for a in queries for p in texts if ratio(a, p) >= least)


def test_marks_are_used_where_they_save_pairs(spark):
    rng = random.Random(9)
    texts = ["".join(chr(0x4E00 + rng.randrange(2500)) for _ in range(rng.randint(8, 25))) for _ in range(300)]
    queries = [t[:-2] + "xy" for t in texts[::30]] + texts[::50]
    got = similar.similar_texts(*frames(spark, texts, list(dict.fromkeys(queries))), 0.6)
    assert sorted(map(tuple, got.collect())) == sorted((a, p, ratio(a, p)) for a in dict.fromkeys(queries) for p in texts if ratio(a, p) >= 0.6)
    marks = similar.indexed(frames(spark, texts, [])[0], 0.6, {}).groupBy("mark").count()
    assert marks.filter("count > 60").count() == 0


def test_all_part_names(spark, small):
    names = [r.p_name for r in spark.read.parquet(f"{small}/part.parquet").select("p_name").distinct().collect()]
    got = {(r.asked, r.plain) for r in similar.similar_texts(*frames(spark, names, names), 0.6).collect()}
    assert got == {(a, p) for a in names for p in names if ratio(a, p) >= 0.6}


def test_limits_and_empty(spark):
    with pytest.raises(ValueError, match="least"):
        similar.similar_texts(*frames(spark, [], []), 0)
    assert similar.similar_texts(*frames(spark, ["a"], []), 0.5).count() == 0 == similar.similar_texts(*frames(spark, [], ["a"]), 0.5).count()

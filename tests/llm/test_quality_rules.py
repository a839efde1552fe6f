from __future__ import annotations

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import quality_rules as Q

from .. import oracle


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered), sum(a == b for a, b in zip(words, words[1:]))


@settings(max_examples=200)
@given(st.text(alphabet="ab é \n\t\x0b\x1c#|", max_size=120))
def test_counts(text):
    assert Q.counts(text.encode()) == brute(text)


def test_counts_of_a_very_long_text():
    text = "one two three four five six " * 30_000
    assert Q.counts(text.encode())[5] == 180_000


def test_collision_is_compared(monkeypatch):
    monkeypatch.setattr(Q, "_mix", lambda ids, salt: np.zeros(len(ids), np.uint64))
    words = b"a b c d e f g a b c d e x".split()
    assert Q.repeated_words(words) == 10


def test_same_as_sql(spark, small):
    from quirespark.llm import queries

    name = "op2_quality_rules"
    oracle.same(queries.queries()[name](spark, small), oracle.connect(small), queries.oracle_sql()[name])


def corpus():
    clean = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}ord" for k in range(40)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    junk = [(1000 + i, " ".join(f"x{k}### |" for k in range(30)), "en", "hot") for i in range(20)]
    odd = [(None, None, None, None), (2000, "", "en", "hot"), (2001, "a b c", "en", "hot"), (2002, "word " * 20, "xx", None)]
    return clean, junk, odd


def test_keeps_clean_drops_junk(spark):
    clean, junk, odd = corpus()
    docs = spark.createDataFrame([(*r, True) for r in clean + junk + odd], "doc_id long, text string, lang string, source string, kept boolean")
    got = {r.doc_id: r.kept for r in Q.judged(docs).collect()}
    assert len(got) == len(clean + junk + odd)
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk + odd)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in clean}


def test_junk_of_two_fifths_of_a_source(spark):
    """The upper quartile of symbols is junk; the lower half still tells what is far."""
    clean, _, _ = corpus()
    own = [r for r in clean if r[3] == "hot"]
    junk = [(5000 + i, " ".join(f"x{k}v{i} ### |" if (k + i) % 9 else f"x{k} #" for k in range(30)), "en", "hot") for i in range(len(own) * 2 // 3)]
    docs = spark.createDataFrame(own + junk, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in Q.judged(docs).filter("kept").collect()} == {r[0] for r in own}


def test_sketches_merge(spark):
    clean, junk, _ = corpus()
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    whole = Q.sketches(Q.with_counts(docs))
    parts = Q.sketches(Q.with_counts(docs.filter("doc_id % 2 = 0"))).unionByName(Q.sketches(Q.with_counts(docs.filter("doc_id % 2 = 1"))))
    key = ["lang", "source", "measure", "bucket"]
    merged = parts.groupBy(*key).sum("n").toDF(*key, "n")
    assert sorted(map(tuple, whole.select(*key, "n").collect())) == sorted(map(tuple, merged.collect()))


def test_quantile_error(spark):
    values = np.linspace(1, 50, 999)
    docs = spark.createDataFrame([("m", float(v)) for v in values], "measure string, v double").select("measure", Q.bucket(__import__("pyspark.sql.functions", fromlist=["col"]).col("v")).alias("bucket")).groupBy("measure", "bucket").count().withColumnRenamed("count", "n")
    row = Q.quartiles(docs, []).first()
    assert abs(row.q1 / np.quantile(values, 0.25) - 1) < 0.02 and abs(row.q3 / np.quantile(values, 0.75) - 1) < 0.02


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.judged(docs).count() == 0 and Q.keep_good(docs).count() == 0

from __future__ import annotations

import numpy as np
import pytest

from quirespark.llm import quality_classifier as Q


def test_word_features():
    f = Q.word_features('"Idiot!,')
    assert f == Q.word_features("idiot") and len(f) == 1 + 2 + 1 and Q.word_features("...") == []


def synthetic(seed, n=900):
    rng = np.random.default_rng(seed)
    grade = rng.integers(0, 3, n)
    features = []
    for g in grade:
        own = {int(x) for x in rng.integers(100, 4000, 60)}
        own |= {int(x) for x in rng.choice(10, 3)} if g == 1 else set()  # marks of grade 1
        own |= {int(x) for x in rng.choice(np.arange(20, 30), 4)} if g == 0 else set()
        features.append(np.array(sorted(own)))
    return features, grade


def test_ordinal_fit_on_held_out_rows():
    features, grade = synthetic(0)
    names = np.arange(4001)
    model = Q.fit(features[:600], grade[:600], np.bincount(grade[:600]) / 600, names)
    assert (np.diff(model.thresholds) >= 0).all()
    index = {int(f): w for f, w in zip(model.features, model.weights)}
    score = np.array([sum(index.get(int(x), 0) for x in f) for f in features[600:]])
    tails = model.tails(score)
    assert (tails[:, 0] >= tails[:, 1]).all()
    found = 2 - (tails < 0.5).sum(1)
    assert (found == grade[600:]).mean() > 0.9


def naive_loss(w, theta, features, grade, weight):
    """Text by text and grade by grade, from the definition."""
    total = 0.0
    for f, g, a in zip(features, grade, weight):
        s = sum(w[k] for k in f)
        upto = [0.0, *(1 / (1 + np.exp(s - t)) for t in theta), 1.0]
        total -= a * np.log(upto[g + 1] - upto[g])
    return total


def test_likelihood_and_gradient_against_brute_force():
    rng = np.random.default_rng(4)
    features = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(40)]
    grade, weight = rng.integers(0, 3, 40), rng.random(40)
    w, theta = rng.normal(size=12), np.array([-0.7, 0.9])
    rows, flat = np.repeat(np.arange(40), [len(f) for f in features]), np.concatenate(features)
    value, by_w, by_theta = Q.loss(w, theta, rows, flat, grade, weight)
    assert np.isclose(value, naive_loss(w, theta, features, grade, weight))
    for x, g in ((w, by_w), (theta, by_theta)):
        for k in range(len(x)):
            at = x[k]
            x[k] = at + 1e-6
            more = naive_loss(w, theta, features, grade, weight)
            x[k] = at - 1e-6
            assert np.isclose(g[k], (more - naive_loss(w, theta, features, grade, weight)) / 2e-6, atol=1e-5)
            x[k] = at


def test_cut_against_all_cuts():
    rng = np.random.default_rng(6)
    clean, others = rng.beta(6, 2, 60), rng.beta(2, 5, 50)
    cost = lambda c: Q.WEIGHT * (clean < c).mean() + (others >= c).mean()
    assert np.isclose(cost(Q.cut(clean, others)), min(cost(c) for c in np.linspace(0, 1, 20_001)))
    assert Q.cut(clean[:5], others) == Q.CUT


def test_features_are_chosen_by_counts(spark):
    texts = [(i % 3, " ".join(f"word{chr(97 + k)}{'xyz'[i % 3] if k < 4 else ''}" for k in range(12) if (i * 7 + k) % 5)) for i in range(60)]
    got = Q.chosen_features(spark.createDataFrame(texts, "grade int, text string"), {g: 20 for g in range(3)}, keep=30)
    seen = {}
    for g, t in texts:
        for f in Q.text_features(t):
            seen.setdefault(f, [0, 0, 0])[g] += 1
    chi = lambda n: sum(20 * (x / 20 - sum(n) / 60) ** 2 for x in n) / max(1e-9, sum(n) / 60 * (1 - sum(n) / 60) + 1 / 60)
    want = sorted((-round(chi(n), 9), f) for f, n in seen.items() if sum(n) >= 3)[:30]
    assert got.tolist() == sorted(f for _, f in want)


def test_one_text_of_each_rated_id(spark):
    """The fit doesn't depend on the order of rows or on how they are dealt."""
    rows = [(i, f"plain number {i % 7} in good text") for i in range(30)] + [(100 + i, f"awful### idiot {i % 5} ###") for i in range(30)] + [(i, f"another text {i}") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    models = [Q.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert all(np.array_equal(getattr(models[0], k), getattr(models[1], k)) for k in ("features", "weights", "thresholds")) and models[0].cut == models[1].cut


def test_held_out_documents(spark, small):
    docs, labels = spark.read.parquet(f"{small}/../sf0.01/documents.parquet"), spark.read.parquet(f"{small}/../sf0.01/labels.parquet")
    model = Q.train(docs, labels, skip="doc_id % 3 = 0")
    rows = Q.grades(labels).filter("doc_id % 3 = 0").join(Q.scored(docs, model), "doc_id").collect()
    by = {g: [r["__p_top"] >= 0.7 for r in rows if r.grade == g] for g in range(3)}
    assert np.mean(by[2]) > 0.95 and np.mean(by[0]) < 0.1


def test_rows_and_columns(spark):
    clean = [(i, f"plain words number {i % 9} in a row of good text", 1) for i in range(40)]
    bad = [(100 + i, f"awful### text!! idiot {i % 9} ###", 2) for i in range(40)]
    odd = [(None, None, 3), (500, "", 4), (501, "plain words in a row " * 30_000, 5), (0, "plain words number 0 in a row of good text", 6)]
    docs = spark.createDataFrame([(*r, "x") for r in clean + bad + odd], "doc_id long, text string, __p_top int, kept string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in clean] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (3, None, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.graded(docs, labels)
    assert got.count() == len(clean + bad + odd)
    kept = {r.doc_id for r in got.filter("kept").collect()}
    assert {r[0] for r in clean} <= kept and not kept & {r[0] for r in bad}
    rows = Q.keep_clean(docs, docs, labels)
    assert rows.columns == docs.columns and {r.doc_id for r in rows.collect()} == kept


@pytest.mark.parametrize("ratings", [[], [(1, 1, 0)]])
def test_without_two_grades_all_stay(spark, ratings):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert Q.graded(docs, spark.createDataFrame(ratings, "doc_id long, quality int, toxic int")).filter("kept").count() == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.graded(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_broken_texts_count_as_replaced(spark):
    rows = [(i, f"plain words number {i % 9} in a row of good text") for i in range(40)] + [(100 + i, f"awful### text!! idiot {i % 9} ###") for i in range(40)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    broken, replaced = (docs.selectExpr("doc_id", f"if(doc_id % 5 = 0, cast(concat(cast(text as binary), X'{x}') as string), text) text") for x in ("20C320FF", "20EFBFBD20EFBFBD"))
    found = [{r.doc_id: r.p_clean for r in Q.graded(d, labels).collect()} for d in (broken, replaced)]
    assert len(found[0]) == 80 and found[0].keys() == found[1].keys() and sum(abs(found[0][d] - found[1][d]) < 0.01 for d in found[0]) == 80

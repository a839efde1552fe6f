"""Quality by ordinal regression: one score per text, ordered thresholds that cut it into grades (cumulative link, logistic).

P(grade <= k) = 1 / (1 + exp(score - threshold_k)). The score sums weights of hashed features that a text has: its words,
their runs of four and five characters, their first five to eight characters, and steps of a few shares (symbols, capitals, distinct words). The weights are shared by all
grades and mostly zero (L1). From them come the expected grade and the tail probability of the best grade, by which texts are kept.

Ratings: ``labels`` has quality and toxic; grade 0 is low quality, 1 good but toxic, 2 good and clean. The model is fitted on a bounded
sample: at most ``sample`` rated documents of each grade, those whose hashed doc_id is smallest; every fifth of them (by another hash) is held out, and the least tail probability of a kept
text is chosen on those (``cut``). Features are counted and chosen by the tasks; the driver gets the chosen ones alone, at most FEATURES numbers for each sampled text however long
it is. Every row of ``docs`` is scored.

Defined results: a null or empty text has the features of no words. Repeated rows score alike. Ratings with a null, or without a document,
are not used. Of several texts with one rated doc_id that of the smallest hash counts. Without ratings of at least two grades all documents are kept. Columns other than doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, holds, light_batches, pieces, shielded, strings, written

BITS = 24
GRADES = 3
SAMPLE = 1875
FEATURES = 4096
#: One in so many sampled texts is held out; a lost clean text weighs as much as so many kept others; the cut without enough held-out texts (FEW of each side).
HELD_OUT, WEIGHT, CUT, FEW = 5, 3.0, 0.65, 20
SYMBOL = re.compile(r"[^\w\s.,;:!?'’\"()\-]")
MARKS = ".,;:!?'\"()[]{}"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def word_features(word: str) -> list[int]:
    word = word.strip(MARKS).lower()
    if not word:
        return []
    starts = (bucket("^" + word[:n]) for n in range(5, min(9, len(word))))
    return [bucket("=" + word), *starts, *(bucket(word[i : i + n]) for n in (4, 5) for i in range(len(word) - n + 1))]


def step_features(text: str, words: list[str], distinct: int) -> list[int]:
    n = max(1, len(words))
    shares = {"symbol": len(SYMBOL.findall(text)) / n, "capital": sum(map(str.isupper, words)) / n, "distinct": distinct / n, "exclaim": text.count("!") / n}
    return [bucket(f"#{k}{min(9, int(v * 10))}") for k, v in shares.items()]


class Signatures(dict):
    """word -> number of the set of the model's features that the word has; 0 if it has none."""

    def __init__(self, index: dict[int, int]):
        self.index, self.numbers, self.sets = index, {(): 0}, [()]

    def __missing__(self, word: str) -> int:
        own = tuple(sorted({self.index[f] for f in word_features(word) if f in self.index}))
        number = self.numbers.get(own)
        if number is None:
            number = self.numbers[own] = len(self.sets)
            self.sets.append(own)
        if len(word) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[word] = number
        return number


@dataclass
class Model:
    features: np.ndarray  # hash buckets
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = CUT

    def scorer(self):
        index = {int(f): i for i, f in enumerate(self.features)}
        signatures = Signatures(index)

        def score(text: str | None) -> float:
            words = (text or "").split()
            found: set[int] = set()
            for s in set(map(signatures.__getitem__, words)):
                found.update(signatures.sets[s])
            found.update(index[f] for f in step_features(text or "", words, len(set(words))) if f in index)
            return float(self.weights[list(found)].sum()) if found else 0.0

        return score

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), for k = 1, 2, ... side by side."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def loss(w: np.ndarray, theta: np.ndarray, rows: np.ndarray, flat: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of the grades, and its gradients by weights and thresholds. rows and flat: text and feature of each pair that is present."""
    n = len(grade)
    s = np.bincount(rows, w[flat], n)
    cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - theta[None, :], -500, 500))), np.ones((n, 1))], axis=1)  # P(grade <= k - 1)
    below, upto = cum[np.arange(n), grade], cum[np.arange(n), grade + 1]
    d_below, d_upto = below * (1 - below), upto * (1 - upto)
    p = np.maximum(upto - below, 1e-12)
    by_score = weight * (d_upto - d_below) / p
    by_theta = np.array([(weight * (np.where(grade - 1 == k, d_below, 0) - np.where(grade == k, d_upto, 0)) / p).sum() for k in range(len(theta))])
    return float(-(weight * np.log(p)).sum()), np.bincount(flat, by_score[rows], len(w)), by_theta


def fit(features: list[np.ndarray], grade: np.ndarray, share: np.ndarray, names: np.ndarray, l1: float = 5e-4, rounds: int = 1000, pace: float = 0.1) -> Model:
    """features: each text's positions in ``names``, the chosen buckets; share: how much of all ratings each grade has. Adam with a proximal step, slower and slower."""
    weight = (share / np.maximum(1, np.bincount(grade, minlength=GRADES)))[grade]
    weight = weight / weight.sum()
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.concatenate([np.array([], np.int64), *features]).astype(np.int64)
    w, theta = np.zeros(len(names)), np.log(np.maximum(1e-6, np.cumsum(share)[:-1]) / np.maximum(1e-6, 1 - np.cumsum(share)[:-1]))
    mw, vw, mt, vt = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(theta)), np.zeros(len(theta))
    for r in range(1, rounds + 1):
        _, g, dt = loss(w, theta, rows, flat, grade, weight)
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        mt, vt = 0.9 * mt + 0.1 * dt, 0.99 * vt + 0.01 * dt * dt
        step = pace * (1 - (r - 1) / rounds)
        rate_w = step / (np.sqrt(vw / (1 - 0.99**r)) + 1e-6)
        w = w - rate_w * mw / (1 - 0.9**r)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate_w * l1)
        theta = np.sort(theta - step * mt / (1 - 0.9**r) / (np.sqrt(vt / (1 - 0.99**r)) + 1e-6))
    used = w != 0
    return Model(names[used], w[used], theta)


def cut(clean: np.ndarray, others: np.ndarray) -> float:
    """The tail probability that parts held-out clean texts from others best: halfway between neighbouring values, the lowest of equal ones. A lost clean text weighs WEIGHT times a kept other one."""
    if min(len(clean), len(others)) < FEW:
        return CUT
    values = np.unique(np.concatenate([[0.0], clean, others, [1.0]]))
    at = (values[1:] + values[:-1]) / 2
    cost = WEIGHT * np.searchsorted(np.sort(clean), at) / len(clean) + 1 - np.searchsorted(np.sort(others), at) / len(others)
    return float(at[int(np.argmin(cost))])


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade of every rating that has both columns; several ratings of a document count as the lowest."""
    own = columns_of(labels, ["doc_id", "quality", "toxic"]).dropna()
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, skip: str | None = None) -> Model | None:
    """Fits the model on a bounded sample; ``skip``: an SQL condition on doc_id for ratings that are held out."""
    light_batches(docs.sparkSession)
    rated = grades(labels)
    if skip:
        rated = rated.filter(f"not ({skip})")
    share = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    parts = [rated.filter(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for g in sorted(share)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    ids = [(r.doc_id, r.grade) for r in chosen.collect()]  # at most GRADES * sample
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, grade int")
    own = columns_of(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(few), "doc_id")
    one = own.groupBy("doc_id", "grade").agg(F.min(F.struct(F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"), "text")).alias("first"))
    texts = written(one.select("doc_id", "grade", (F.pmod(F.xxhash64(F.try_add("doc_id", F.lit(1))), F.lit(HELD_OUT)) == 0).alias("out"), F.col("first.text").alias("text")), "rated")
    sizes = {r.grade: r.n for r in texts.groupBy("grade").agg(F.count_if(~F.col("out")).alias("n")).collect() if r.n}
    if len(sizes) < 2:
        texts, sizes = texts.withColumn("out", F.lit(False)), {r.grade: r.n for r in texts.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    names = chosen_features(texts.filter("not out"), sizes)
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 100)):
            found = [np.array(text_features(t), np.int64) for t in strings(batch.column(2))]
            inside = [np.searchsorted(shared.value, f[np.isin(f, shared.value, assume_unique=True)]).astype(np.int32) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inside, pa.list_(pa.int32()))], names=["grade", "out", "features"])

    got = texts.select("grade", "out", "text").orderBy("doc_id").mapInArrow(place, "grade int, out boolean, features array<int>").toArrow()
    grade, out = got.column("grade").to_numpy().astype(np.int64), got.column("out").to_numpy()
    column = got.column("features").combine_chunks()
    values, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    features = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    inside = [f for f, o in zip(features, out) if not o]
    model = fit(inside, grade[~out], np.array([share.get(g, 0) for g in range(GRADES)], float) / sum(share.values()), names)
    weights = np.zeros(len(names))
    weights[np.searchsorted(names, model.features)] = model.weights
    top = model.tails(np.array([weights[f].sum() for f, o in zip(features, out) if o]))[:, -1]
    model.cut = cut(top[grade[out] == GRADES - 1], top[grade[out] < GRADES - 1])
    return model


def text_features(text: str | None) -> list[int]:
    """The distinct features of a text, in order."""
    words = (text or "").split()
    distinct = set(words)
    return sorted({f for w in distinct for f in word_features(w)} | set(step_features(text or "", words, len(distinct))))


def chosen_features(texts: DataFrame, sizes: dict[int, int], keep: int = FEATURES, least: int = 3) -> np.ndarray:
    """The ``keep`` features, of those that ``least`` texts have, on which grades differ most (chi squared), in order. Texts are counted by feature and grade in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 100)):
            for g in set(batch.column(0).to_pylist()):
                own = strings(batch.filter(pa.compute.equal(batch.column(0), g)).column(1))
                values, n = np.unique(np.fromiter((f for t in own for f in text_features(t)), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), g), pa.int32()), pa.array(values), pa.array(n)], names=["grade", "feature", "n"])

    counted = texts.select("grade", "text").mapInArrow(count, "grade int, feature long, n long")
    each = counted.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("grade") == g, F.col("n"))), F.lit(0)).alias(f"n{g}") for g in range(GRADES)])
    total, whole = sum(F.col(f"n{g}") for g in range(GRADES)), sum(sizes.values())
    share = total / whole
    chi = sum((F.lit(float(sizes[g])) * F.pow(F.col(f"n{g}") / sizes[g] - share, F.lit(2)) for g in sorted(sizes)), F.lit(0.0)) / F.greatest(F.lit(1e-9), share * (1 - share) + 1.0 / whole)
    best = each.filter(total >= least).orderBy(F.desc(F.round(chi, 9)), "feature").limit(keep)
    return np.array(sorted(r.feature for r in best.select("feature").collect()), np.int64)


def scored(docs: DataFrame, model: Model | None, keep_rows: bool = False) -> DataFrame:
    """doc_id (or, with ``keep_rows``, all columns of ``docs``) with __expected_grade, __p_top (best grade) and __p_1 (at least grade 1)."""
    light_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs if keep_rows else columns_of(docs, ["doc_id", "text"])
    kept = rows.columns if keep_rows else ["doc_id"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds()
        score = shared.value.scorer() if shared.value else None
        for batch in (x for b in batches for x in pieces(b, 1000)):
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            if score is None:
                tails = np.ones((batch.num_rows, GRADES - 1))
            else:
                tails = shared.value.tails(np.array([score(t) for t in strings(batch.column(batch.schema.get_field_index("text")))]))
            yield pa.RecordBatch.from_arrays([*own, pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, 0])], names=[*kept, "__expected_grade", "__p_top", "__p_1"])

    return rows.mapInArrow(make, ", ".join([*fields, "`__expected_grade` double, `__p_top` double, `__p_1` double"]))


def graded(docs: DataFrame, labels: DataFrame, least: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, p_good (at least grade 1), p_clean (grade 2), kept (p_clean at least ``least``, by default the model's cut) of every row."""
    model = train(docs, labels, sample)
    found, least = scored(docs, model), least if least is not None or not model else model.cut
    least = 0.0 if least is None else least
    return found.select("doc_id", F.col("__expected_grade").alias("expected_grade"), F.col("__p_1").alias("p_good"), F.col("__p_top").alias("p_clean"), (F.col("__p_top") >= least).alias("kept"))


def keep_clean(docs: DataFrame, rated: DataFrame, labels: DataFrame, least: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns as they are; it is fitted on the texts of ``rated``."""
    own, back = shielded(docs, ("text",))
    model = train(rated, labels, sample)
    least = least if least is not None else model.cut if model else 0.0
    return back(scored(own, model, keep_rows=True).filter(F.col("__p_top") >= least))

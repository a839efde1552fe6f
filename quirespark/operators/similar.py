"""Similarity join of short texts by the ratio of their matching parts, through an index of prefixes.

The ratio of two texts of n and m characters is 2 * M / (n + m), M being the characters in blocks that match in order; M is at most the characters that both have, counted with their repetitions. So a ratio of ``least``
asks for least * (n + m) / 2 common characters, and of a text of n characters for n * least / (2 - least) with any partner. A text's characters, each with the number of its repetition ('e' the first, 'e' the second), are put in one
order for all texts, rare ones first; texts with so many in common must share one among the first n - n * least / (2 - least) + 1 of each. Texts meet by these alone, and only where what is left behind the shared one
can still be enough; a pair is compared where it shares its first. What is found is exact, in whatever order characters are put.

How much this saves hangs on the texts: with large alphabets (Chinese titles) or a high ``least`` few pairs meet; texts of a small alphabet share most characters whatever they say, and at 0.6 meet at several marks. The
marks are counted before anything meets: where that would be more pairs than there are, every text gets one and the same mark, so that each pair meets once.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries and texts that one group compares.
QUERIES, TEXTS = 1000, 8000
#: The mark of all texts, where marks of their own save nothing.
ALL = ""
#: Texts whose characters are counted for the order, and the longest of them.
SAMPLE, LONGEST = 20_000, 1000


def numbered(text: str) -> list[tuple[str, int]]:
    """The characters of a text with the number of their repetition."""
    seen: Counter[str] = Counter()
    out = []
    for c in text:
        out.append((c, seen[c]))
        seen[c] += 1
    return out


def prefix(text: str, least: float, often: dict[tuple[str, int], int]) -> list[str]:
    """The numbered characters of a text of which any text that is similar enough shares one, in order; ``often`` says how many texts have each."""
    n = len(text)
    enough = math.ceil(n * least / (2 - least) - 1e-9)
    order = sorted(numbered(text), key=lambda x: (often.get(x, 0), x))
    return [f"{c}{k}" for c, k in order[: n - enough + 1]]


def letters(texts: list[str]) -> np.ndarray:
    """How many characters of each text fall in each of 64 classes of characters."""
    out = np.zeros((len(texts), 64), np.int16)
    for i, t in enumerate(texts):
        np.add.at(out[i], np.frombuffer(t.encode("utf-32-le"), "<u4") % 64, 1)
    return out


def order_of(texts: DataFrame) -> dict[tuple[str, int], int]:
    """How many of a bounded sample of texts have each numbered character."""
    text = texts.columns[0]
    some = texts.filter(F.length(text) <= LONGEST).orderBy(F.xxhash64(text), text).limit(SAMPLE)
    return dict(Counter(x for r in some.toLocalIterator() for x in numbered(r[0])))


def indexed(texts: DataFrame, least: float, often: dict[tuple[str, int], int]) -> DataFrame:
    """text, mark and left (how many of the text's characters come after it in the order) for each mark of a text's prefix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in (frame.iloc[i : i + 2000] for i in range(0, len(frame), 2000)):
                rows = [(t, mark, len(t) - i - 1) for t in part["text"] for i, mark in enumerate(prefix(t, least, often))]
                yield pd.DataFrame(rows, columns=["text", "mark", "left"])

    return texts.select(F.col(texts.columns[0]).alias("text")).mapInPandas(run, "text string, mark string, left int")


def ruled(own: pd.DataFrame, other: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each query of a group the texts that no bound rules out: what is left behind the shared mark, and the letters of both."""
    plain, asked = own["plain"].tolist(), other["asked"].tolist()
    here, there = letters(plain), letters(asked)
    sizes, left = np.fromiter(map(len, plain), np.int64), own["left"].to_numpy()
    for i, (a, behind) in enumerate(zip(asked, other["behind"])):
        need = least * (sizes + len(a)) / 2 - 1e-9
        some = np.flatnonzero(1 + np.minimum(left, behind) >= need)
        if len(some):
            some = some[np.minimum(here[some], there[i]).sum(1) >= need[some]]
        if len(some):
            yield i, some


def similar_texts(texts: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(asked, plain, similarity) of all texts at least that similar to a query text; both tables have one column of distinct texts that aren't empty.

    Marks that many texts or queries share are dealt to blocks, so that no group has more than a few thousand of either.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    often = order_of(texts)
    marked = indexed(texts, least, often).select(F.col("text").alias("plain"), "mark", "left")
    wanted = indexed(queries, least, often).select(F.col("text").alias("asked"), "mark", F.col("left").alias("behind"))
    counts = marked.groupBy("mark").agg(F.count("*").alias("ts")).join(wanted.groupBy("mark").agg(F.count("*").alias("qs")), "mark").agg(F.coalesce(F.sum(F.col("ts") * F.col("qs").cast("double")), F.lit(0))).first()
    if counts[0] > texts.count() * queries.count():
        one = lambda rows, name, length: rows.select(F.col(rows.columns[0]).alias(name), F.lit(ALL).alias("mark"), F.length(rows.columns[0]).alias(length))
        marked, wanted = one(texts, "plain", "left"), one(queries, "asked", "behind")
    blocks = lambda rows, name, most: rows.groupBy("mark").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    dealt = blocks(marked, "ts", TEXTS).join(blocks(wanted, "qs", QUERIES), "mark")
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = marked.join(dealt, "mark").select("mark", "plain", "left", hashed("plain", "ts").alias("t"), every("qs").alias("q"))
    q = wanted.join(dealt, "mark").select("mark", "asked", "behind", every("ts").alias("t"), hashed("asked", "qs").alias("q"))

    def ahead(text: str, mark: str) -> list[str]:
        first = prefix(text, least, often) if mark != ALL else [ALL]
        return first[: first.index(mark)]

    def match(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out, found = [], {}
        if len(own) and len(other):
            plain, asked = own["plain"].tolist(), other["asked"].tolist()
            for i, some in ruled(own, other, least):
                before = set(ahead(asked[i], key[0]))
                for j in some.tolist():
                    found.setdefault(j, []).append((i, before))
            for j, those in found.items():
                earlier = ahead(plain[j], key[0])
                matcher = difflib.SequenceMatcher(None, "", plain[j])
                for i, before in those:
                    if before.isdisjoint(earlier):  # else they have met at an earlier mark
                        matcher.set_seq1(asked[i])
                        if matcher.quick_ratio() >= least and (s := matcher.ratio()) >= least:
                            out.append((asked[i], plain[j], s))
        return pd.DataFrame(out, columns=["asked", "plain", "similarity"])

    return t.groupBy("mark", "t", "q").cogroup(q.groupBy("mark", "t", "q")).applyInPandas(match, "asked string, plain string, similarity double")

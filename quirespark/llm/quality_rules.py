"""Quality rules whose cutoffs come from the corpus: quantile sketches per language and source, and a join that filters.

Counts are taken from whole texts. The sketch of a measure is a histogram over buckets whose bounds grow by a constant factor
(as in DDSketch), so every quantile is right within a relative error, and sketches of any parts merge by adding counts. That is a
plain grouped count here, with partial sums before the shuffle. A group of fewer than ``min_rows`` texts takes the sketch of its
language, and a small language that of all texts. From a sketch come median and quartiles; a text fails a measure that lies
further outside the quartiles than ``reach`` times their distance (a measure that hardly varies counts with a least distance), or further
above the median than ``BEYOND`` times ``reach`` times the distance from the lower quartile to it (below it: from it to the upper one; half the least distance at least). The second fence is one of the
better half: where up to half of a group is junk of one kind, the quartile on that side is junk itself and says nothing.

Defined results: a null or empty text has no words and fails the base rule. Null languages and sources form groups of their own.
Repeated rows count each. An empty table gives an empty result. Columns other than doc_id, text, lang and source are ignored.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, holds, per_slice, shielded, utf8, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Relative error of the sketches' quantiles.
ERROR = 0.01
#: measure -> (side that fails, least distance of the quartiles)
MEASURES = {"symbols_per_word": ("high", 0.02), "echo_share": ("high", 0.05), "dup_line_share": ("high", 0.05), "word_length": ("both", 0.5)}
REACH = 8.0
#: How much further than ``reach`` the fence of the other half stands, in half distances: beyond the first fence unless one half is spread 16 / 9 as wide as the other.
BEYOND = 3.0
MIN_ROWS = 100
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_echo_words long"


def _mix(ids: np.ndarray, salt: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that the list holds twice or more. Exact: equal hashes are compared."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(known) == len(words):
        return 0
    with np.errstate(over="ignore"):
        hashes = np.zeros(n, np.uint64)
        for k in range(window):
            hashes += _mix(ids[k : k + n], 0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if any((ids[a + k] != ids[b + k]).any() for k in range(window)):  # a collision of hashes
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + window]), []).append(i)
        starts = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    else:
        starts = np.unique(np.concatenate([a, b]))
    covers = np.zeros(len(words) + 1, np.int64)
    np.add.at(covers, starts, 1)
    np.add.at(covers, starts + window, -1)
    return int((np.cumsum(covers)[:-1] > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines (that hold a word), n_dup_lines, n_repeat_words, n_echo_words (equal to the word before) of one whole text."""
    text = text or b""
    words = text.split()
    flat = b"".join(words)
    chars = len(flat) if flat.isascii() else len(flat.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words), sum(map(eq, words[1:], words))


def with_counts(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, lang, source and the counts of every row; with ``keep_rows`` all columns of ``docs`` and then the counts as __n_words, ..."""
    if keep_rows:
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
        names, rows = docs.columns, docs
    else:
        fields, names = ["doc_id long", "lang string", "source string"], ["doc_id", "lang", "source"]
        rows = columns_of(docs, [*names, "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    own = [x.split() for x in COUNTS.split(", ")]
    prefix = "__" if keep_rows else ""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        holds()
        found = [counts(t) for t in utf8(batch, "text")]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        columns += [pa.array([f[i] for f in found], pa.int64()) for i in range(len(own))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *(prefix + n for n, _ in own)])

    return rows.mapInArrow(per_slice(make, 500), ", ".join([*fields, *(f"`{prefix}{n}` {t}" for n, t in own)]))


def measures(prefix: str = "") -> dict[str, Column]:
    n = F.greatest(F.col(f"{prefix}n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col(f"{prefix}n_symbols") / n,
        "echo_share": F.col(f"{prefix}n_echo_words") / n,
        "dup_line_share": F.col(f"{prefix}n_dup_lines") / F.greatest(F.col(f"{prefix}n_lines"), F.lit(1)).cast("double"),
        "word_length": F.col(f"{prefix}word_chars") / n,
    }


def base_failed(prefix: str = "") -> Column:
    words, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * repeat > 20 * words)


def bucket(value: Column) -> Column:
    """The bucket of a measure; all under a millionth share the lowest."""
    growth = math.log((1 + ERROR) / (1 - ERROR))
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6))) / F.lit(growth)).cast("int")


def middle(number: Column) -> Column:
    growth = (1 + ERROR) / (1 - ERROR)
    low = math.ceil(math.log(1e-6) / math.log(growth))
    return F.when(number <= low, F.lit(0.0)).otherwise(F.pow(F.lit(growth), number) * F.lit(2 / (1 + growth)))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of all groups, of texts that pass the base rule."""
    values = counted.filter(~base_failed()).select("lang", "source", *[bucket(v).alias(k) for k, v in measures().items()])
    long = values.unpivot(["lang", "source"], list(MEASURES), "measure", "bucket")
    return long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q1, q2 (the median), q3 from sketches merged to these keys."""
    at = merged.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "measure")
    at = at.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    first = lambda share: F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("bucket")))
    return at.groupBy(*keys, "measure").agg(F.first("total").alias("total"), middle(first(0.25)).alias("q1"), middle(first(0.5)).alias("q2"), middle(first(0.75)).alias("q3"))


def thresholds(counted: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source) with low_<measure> and high_<measure> of every group: the range that passes."""
    sketch = written(sketches(counted), "sketches")
    groups = counted.select("lang", "source").distinct()
    own, by_lang, of_all = (quartiles(sketch, k) for k in (["lang", "source"], ["lang"], []))

    def wide(found: DataFrame, keys: list[str], tag: str, least: int) -> DataFrame:
        spread = F.create_map(*[F.lit(x) for m, (_, s) in MEASURES.items() for x in (m, s)])[F.col("measure")]
        iqr = F.greatest(F.col("q3") - F.col("q1"), spread)
        below, above = (BEYOND * reach * F.greatest(d, spread / 2) for d in (F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")))
        row = found.filter(F.col("total") >= least).withColumn("low", F.greatest(F.col("q1") - reach * iqr, F.col("q2") - above)).withColumn("high", F.least(F.col("q3") + reach * iqr, F.col("q2") + below))
        pick = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{tag}_{side}_{m}") for m in MEASURES for side in ("low", "high")]
        return row.groupBy(*[F.col(k).alias(f"{tag}_{k}") for k in keys]).agg(*pick)

    a, b, c = wide(own, ["lang", "source"], "a", min_rows), wide(by_lang, ["lang"], "b", min_rows), wide(of_all, [], "c", 1)
    joined = groups.join(a, F.col("lang").eqNullSafe(F.col("a_lang")) & F.col("source").eqNullSafe(F.col("a_source")), "left").join(b, F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    joined = joined.join(F.broadcast(c), F.lit(True), "left")  # one row
    return joined.select("lang", "source", *[F.coalesce(*[F.col(f"{t}_{side}_{m}") for t in "abc"]).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")])


def passes(prefix: str = "") -> Column:
    ok = F.lit(True)
    for m, v in measures(prefix).items():
        ok = ok & (F.col(f"high_{m}").isNull() | (v <= F.col(f"high_{m}")))
        if MEASURES[m][0] == "both":
            ok = ok & (F.col(f"low_{m}").isNull() | (v >= F.col(f"low_{m}")))
    return ok


def judged(docs: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept of every row."""
    counted = written(with_counts(docs), "counts")
    limits = thresholds(counted, reach, min_rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return counted.join(limits, same, "left").select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"))


def keep_good(docs: DataFrame, reach: float = REACH, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that the rules keep, all columns as they are. Texts are counted twice rather than shuffled to their counts."""
    limits = written(thresholds(written(with_counts(docs), "counts"), reach, min_rows), "thresholds")
    limits = limits.withColumnsRenamed({c: f"__{c}" for c in ("lang", "source")})
    own, back = shielded(docs, ("text", "lang", "source"))
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    return back(with_counts(own, keep_rows=True).join(limits, same, "left").filter(~base_failed("__") & passes("__")))

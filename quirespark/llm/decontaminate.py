"""Benchmark decontamination by templates: finds benchmark items in documents, also with other numbers, units and names.

Words are canonical: lower case, without marks around them. Numbers become one placeholder, and units after a number another
(template 1); template 2 also replaces names, that is words with a capital (a sentence's first word among them). What stands for a placeholder is a slot.
A window begins or ends at any word and is the shortest stretch from or to there of at least ``window`` words of which half of ``window`` are no slots (at most STRETCH times
``window`` words): where slots are dense it is longer, so that windows say something and no word is left out for its slots. Where more than half of ``window`` words are
numbers and units, those words also make a window literally (template 0), so that lists of numbers are found verbatim. Windows are hashed and
joined: those of all documents, thinned by a bitmap of bounded size, with those of the distinct texts of the benchmark. Windows of one document and one text
that lie on one diagonal and follow one another make a run while their slots agree: each value of the item stands for one value of the
document, and the other way round. A window whose slots conflict with those before it ends the run. If names conflict (they are guesses: a sentence's
first word is no name) the next run begins after the last window that conflicts; if numbers or units do, it begins with this window. Windows
with equal slot values, and those of template 1, are judged alone too, so that what lies beyond a quotation can't spoil it. A run of ``run``
words, or of the whole item if it is shorter, is a leak.

Defined results: null and empty texts have no windows. An item of under ``window`` words is looked for only whole; one of under MIN_WORDS words (template 3) only where it is a whole
document, since it says too little inside one. Items of one text are looked for once and all reported. Repeated rows give one result. A null doc_id or item_id
is a value of its own. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, holds, pieces, shielded, strings, text_key, written

WINDOW, RUN, MIN_WORDS = 8, 13, 5
#: How much longer than ``window`` a window may get where slots are dense.
STRETCH = 3
#: Most bits of the window hash that the bitmap tells apart (2 to this power: 32 MB), and how many bits it has for each window of the benchmark below that.
BITMAP, EACH = 28, 256
#: Words for numbers by language (without those that are also articles), and units. Callers can add to both.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half quarter dozen",
    "de": "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden dutzend",
    "fr": "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille million millions milliard milliards douzaine",
    "es": "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena",
}
UNITS = "mm cm dm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw watt watts v volt volts j joule joules n newton newtons pa bar k c f degree degrees percent % $ € £ dollar dollars euro euros cent cents km/h mph m/s kb mb gb tb bit bits byte bytes meter metern mètre mètres metro metros kilometer kilomètre kilomètres kilómetro kilómetros gramm gramme grammes gramo gramos kilo kilos tonnen tonelada toneladas litro litros sekunde sekunden seconde secondes segundo segundos minuten minuto minutos stunde stunden heure heures hora horas tag tage tagen jour jours día días woche wochen semaine semaines semana semanas monat monate monaten mois mes meses jahr jahre jahren an ans année années año años prozent grad"
NUMBER = re.compile(r"[+\-$€£]?\d+(?:[.,:/]\d+)*[%°€$£]?|\d+(?:st|nd|rd|th)|\d[\d.,]*[a-z]{1,4}")
EDGE = re.compile(r"^[^\w+\-$€£%°]+|[^\w%°€$£]+$")
IS_NUMBER, IS_UNIT, IS_CAPITAL = 1, 2, 4
EXACT, PLAIN, NAMES, WHOLE = 0, 1, 2, 3  # the templates
WORDS = {"numbers": frozenset(w for text in NUMBER_WORDS.values() for w in text.split()), "units": frozenset(UNITS.split())}


class Canonical(dict):
    """word -> 60 bits of its canonical form's hash, and flags."""

    def __init__(self, numbers: frozenset[str], units: frozenset[str]):
        self.numbers, self.units = numbers, units

    def __missing__(self, word: str) -> int:
        bare = EDGE.sub("", word)
        low = bare.lower()
        flags = IS_NUMBER if low in self.numbers or NUMBER.fullmatch(low) else 0
        flags |= IS_UNIT if low in self.units else 0
        flags |= IS_CAPITAL if bare[:1].isupper() and not flags else 0
        value = xxhash.xxh64_intdigest(low) & ~15 | flags
        if len(word) <= 64:
            if len(self) > 500_000:
                self.clear()
            self[word] = value
        return value


@lru_cache(maxsize=4)
def canonical(numbers: tuple[str, ...] = (), units: tuple[str, ...] = ()) -> Canonical:
    """One table of words for each set of added number words and units, kept by a Python worker from task to task."""
    return Canonical(WORDS["numbers"] | set(numbers), WORDS["units"] | set(units))


_MASK = np.uint64(2**64 - 16)
_SLOTS = {k: np.uint64(xxhash.xxh64_intdigest(k) & ~15) for k in ("<number>", "<unit>", "<name>")}
_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=None)  # one entry for each power of two up to the longest text
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of the hash's factor, and their inverses modulo 2 ** 64."""
    both = []
    for base in (_FACTOR, pow(_FACTOR, -1, 2**64)):
        out = np.ones(1 << bits, np.uint64)
        for b in range(bits):
            out[1 << b : 2 << b] = out[: 1 << b] * np.uint64(pow(base, 1 << b, 2**64))
        both.append(out)
    return both[0], both[1]


def hashes_of(words: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words from ``at`` to ``end``, by its polynomial, which differences of running sums give."""
    up, down = powers(max(14, len(words).bit_length()))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    total = (sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64)
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def stretches(slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of all windows: the shortest stretch from each word, and to each word, of ``size`` words or more with (size + 1) // 2 or more that are no slots."""
    at, end = _from_each(slot, size)
    if not slot.any():
        return at, at + size
    back, first = _from_each(slot[::-1], size)
    back, first = len(slot) - back, len(slot) - first
    own = np.full(len(slot) + 1, -1)
    own[at] = end
    other = own[first] != back
    return np.concatenate([at, first[other]]), np.concatenate([end, back[other]])


def _from_each(slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n, need = len(slot), (size + 1) // 2
    at = np.arange(max(0, n - size + 1))
    literal = np.flatnonzero(~slot)
    last = np.cumsum(~slot)[at] - ~slot[at] + need - 1  # which literal word ends it
    fits = last < len(literal)
    at, last = at[fits], last[fits]
    end = np.maximum(at + size, literal[last] + 1)
    fits = end - at <= STRETCH * size
    return at[fits], end[fits]


def inside(marks: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many marked words lie between ``at`` and ``end``."""
    before = np.concatenate(([0], np.cumsum(marks)))
    return before[end] - before[at]


def windows(words: list[str], sizes: tuple[int, ...], bitmap: tuple[np.ndarray, int] | None, least: int, table: Canonical) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
    """(template, position, size, words, hash, slot values) of the windows, or of those that the bitmap lets through. Template 2 has windows with a name only: others are as in template 1."""
    value = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    flag, plain = value & np.uint64(15), value & _MASK
    found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # template, size, words' hashes, slots, firsts, ends
    if words and len(words) < least:
        found.append((WHOLE, len(words), plain, np.zeros(len(words), bool), np.array([0]), np.array([len(words)])))
    number = flag & np.uint64(IS_NUMBER) > 0
    unit = np.zeros(len(words), bool)
    unit[1:] = (flag[1:] & np.uint64(IS_UNIT) > 0) & number[:-1] & ~number[1:]
    name = flag & np.uint64(IS_CAPITAL) > 0
    set_in = plain
    if number.any():
        set_in = plain.copy()
        set_in[number], set_in[unit] = _SLOTS["<number>"], _SLOTS["<unit>"]
    if named := bool(name.any()):
        called = set_in.copy()
        called[name] = _SLOTS["<name>"]
    for size in sizes if len(words) >= least else ():
        if len(words) < size:
            continue
        found.append((PLAIN, size, set_in, number | unit, *stretches(number | unit, size)))
        if number.any():
            at = np.arange(len(words) - size + 1)
            at = at[inside(number | unit, at, at + size) * 2 > size]
            found.append((EXACT, size, plain, number | unit, at, at + size))
        if named:
            at, end = stretches(number | unit | name, size)
            own = inside(name, at, end) > 0
            found.append((NAMES, size, called, number | unit | name, at[own], end[own]))
    for t, size, own, slot, at, end in found:
        if not len(at):
            continue
        total = hashes_of(own, at, end)
        if t in (EXACT, WHOLE):
            total ^= np.uint64(t + 1)  # a literal window is no window of placeholders
        if bitmap is not None:
            place = total >> np.uint64(64 - bitmap[1])
            keep = bitmap[0][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
            at, end, total = at[keep], end[keep], total[keep]
        for i, j, h in zip(at.tolist(), end.tolist(), total.view(np.int64).tolist()):
            yield t, i, size, j - i, h, [EDGE.sub("", w).lower() for w, s in zip(words[i:j], slot[i:j]) if s]


#: What is known of a text's windows with one hash, in the order of their positions.
GROUPED = "n_words int, template int, size int, hash long, positions array<int>, lengths array<int>, slots array<array<string>>"


def grouped(found: Iterator[tuple[int, int, int, int, int, list[str]]]) -> list[tuple]:
    """The windows (template, position, size, words, hash, slots) of one text with a row for each template, size and hash."""
    by: dict[tuple[int, int, int], tuple[list, list, list]] = {}
    for template, position, size, length, value, slots in found:
        own = by.setdefault((template, size, value), ([], [], []))
        for into, x in zip(own, (position, length, slots)):
            into.append(x)
    return [(*k, *v) for k, v in by.items()]


def window_table(rows: DataFrame, key: list[str], sizes: tuple[int, ...], bitmap: tuple[np.ndarray, int] | None, least: int, numbers: tuple[str, ...] = (), units: tuple[str, ...] = ()) -> DataFrame:
    """key columns and those of GROUPED of the windows of a column text: one row for each hash that a text has, however often. Without a bitmap a text is an item: one of under the largest size has only windows of all its words."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in key), GROUPED])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("canonical", canonical.cache_clear)
        table = canonical(numbers, units)
        for batch in (x for b in batches for x in pieces(b, 500)):
            at, out = [], []
            for r, text in enumerate(strings(batch.column(len(key)))):
                words = (text or "").split()
                own = sizes if shared.value is not None else (min(len(words), max(sizes)),)
                made = grouped(windows(words, own, shared.value, least, table))
                at += [r] * len(made)
                out += [(len(words), *w) for w in made]
            if out:
                taken = [batch.column(i).take(pa.array(at)) for i in range(len(key))]
                kinds = [*[pa.int32()] * 3, pa.int64(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[*key, *(c.split()[0] for c in GROUPED.split(", "))])

    return rows.select(*key, "text").mapInArrow(make, schema)


def bitmap_of(table: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the windows' hashes (packed bits, and how many leading bits of a hash it tells apart), made in parts by the tasks."""
    bits = min(BITMAP, max(16, math.ceil(math.log2(1 + table.count() * EACH))))
    part = min(bits - 3, 16)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << part, np.uint8)
        marks[rows["low"].to_numpy(np.int64)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    places = table.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).distinct()
    parts = places.select(F.shiftright("bit", part).alias("part"), F.col("bit").bitwiseAND((1 << part) - 1).alias("low"))
    packed = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("part").applyInPandas(pack, "part long, bits binary").toLocalIterator():  # at most 2 ** (BITMAP - 16) rows of 8 KB
        packed[r.part << (part - 3) : (r.part + 1) << (part - 3)] = np.frombuffer(r.bits, np.uint8)
    return packed, bits


def longest(by: list[tuple[int, set[tuple[str, str]]]], size: int | list[int], table: Canonical | None = None) -> tuple[int, int, int]:
    """Of windows in order, each with its pairs of slot values and its size: words, -changed slots and -position of the longest run without a gap or a conflict; zeros without one."""
    table = canonical() if table is None else table
    ends = [at + (size if isinstance(size, int) else size[i]) for i, (at, _) in enumerate(by)]
    best, start, end = (0, 0, 0), 0, 0
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    held: Counter[tuple[str, str]] = Counter()

    def leave(until: int, now: int) -> None:
        nonlocal start, end
        for _, pairs in by[start:until]:
            for x, y in pairs:
                held[x, y] -= 1
                if not held[x, y]:
                    del held[x, y], there[x], back[y]
        start, end = until, max(ends[until:now], default=0)

    for i, (at, pairs) in enumerate(by):
        if i and at > by[i - 1][0] + 1:
            leave(i, i)
        if not len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):  # conflicts in itself
            leave(i, i)
            start = i + 1
            continue
        while clash := [x for x, y in pairs if there.get(x, y) != y or back.get(y, x) != x]:
            leave(i if any(table[x] & (IS_NUMBER | IS_UNIT) for x in clash) else start + 1, i)
        for x, y in pairs:
            there[x], back[y] = y, x
            held[x, y] += 1
        end = max(end, ends[i])
        words = end - by[start][0]
        if words >= best[0]:
            best = max(best, (words, -sum(x != y for x, y in there.items()), -by[start][0]))
    return best


def judged(windows: list, table: Canonical) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Of the windows (template, position, length, item's slots, document's slots) on one diagonal: the longest verbatim run, and the longest of template 1 or of both."""
    picked: list[dict[int, tuple[int, set]]] = [{}, {}, {}]  # equal, plain, both
    for kind, place, length, a, b in windows:
        pairs = set(zip(a, b))
        for k, fits in enumerate((kind != NAMES and list(a) == list(b), kind != NAMES, True)):
            if fits:
                most, known = picked[k].get(place, (0, set()))
                picked[k][place] = (max(most, length), known | pairs)
    best = []
    for own in picked:
        order = sorted(own)
        best.append(longest([(p, own[p][1]) for p in order], [own[p][0] for p in order], table))
    return best[0], max(best[1:])


#: Words of a document that are held against an item at once, at least; parts overlap by the item's length, which no run exceeds.
PART = 2048


def stretches_of(met: list[dict], most: int) -> Iterator[tuple[tuple[int, int, int], list]]:
    """Of the windows that an item and a document share (by hash: where they are in the item, and where in the document): the stretches on diagonals that follow one another without a gap.

    Each with the best that its run could be (words, no changed slots, -first word), the best first, and its windows. The document is taken in parts; a part's stretches are made by numpy, as two texts that
    repeat themselves meet in as many places as the product of their lengths.
    """
    firsts = [p for m in met for p in m["at"]]
    part = max(PART, most)
    for begin in range(min(firsts), max(firsts) + 1, part):
        until = begin + part + most
        p, q, of, here, there = [], [], [], [], []
        for k, m in enumerate(met):
            at, position = np.asarray(m["at"]), np.asarray(m["positions"])
            inside = np.flatnonzero((at >= begin) & (at < until))
            n = len(position)
            p.append(np.repeat(at[inside], n))
            q.append(np.tile(position, len(inside)))
            of.append(np.full(n * len(inside), k))
            here.append(np.repeat(inside, n))
            there.append(np.tile(np.arange(n), len(inside)))
        p, q, of, here, there = (np.concatenate(x) for x in (p, q, of, here, there))
        if not len(p):
            continue
        ends = q + np.concatenate([np.asarray(m["lengths"]) for m in met])[np.concatenate([[0], np.cumsum([len(m["lengths"]) for m in met])])[of] + there]
        order = np.lexsort((q, p - q))
        p, q, of, here, there, ends = (x[order] for x in (p, q, of, here, there, ends))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(p - q) != 0) | (np.diff(q) > 1)]))
        last = np.append(new[1:], len(q))
        words = np.maximum.reduceat(ends, new) - q[new]
        for g in np.lexsort((q[new], -words)):
            a, b = int(new[g]), int(last[g])
            yield (int(words[g]), 0, -int(q[a])), list(zip(of[a:b].tolist(), there[a:b].tolist(), here[a:b].tolist()))


def best_run(met: list[dict], n_words: int, need: int, table: Canonical) -> tuple[int, int, int] | None:
    """(words, -changed slots, -first word) of the best run of ``need`` words or more that an item of n_words words and a document share."""
    best: tuple[int, int, int] | None = None
    for most, own in stretches_of(met, n_words):
        if most[0] < need or best is not None and best >= most:
            continue
        if best == (n_words, 0, 0):
            break
        same, other = judged([(m["template"], m["positions"][j], m["lengths"][j], m["slots"][j], m["doc_slots"][i]) for m, j, i in ((met[k], j, i) for k, j, i in own) if len(m["slots"][j]) == len(m["doc_slots"][i])], table)
        told = [(w, changed, first) for w, changed, first in ((same[0], 0, same[2]), other) if w >= need]
        best = max([*told, *([best] if best else [])], default=None)
    return best


def run_of(run: int, numbers: tuple[str, ...], units: tuple[str, ...]):
    def find(w: pd.Series, n: pd.Series) -> pd.DataFrame:
        """Of each document and item: words, -changed slots and -first word of the best run, or nulls."""
        table, out = canonical(numbers, units), []
        for rows, words in zip(w, n):
            out.append(best_run(list(rows), int(words), min(run, int(words)), table) or (None, None, None))
        return pd.DataFrame(out, columns=["run", "same", "first"], dtype="Int32")

    return F.pandas_udf(find, "run int, same int, first int")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, numbers: tuple[str, ...] = (), units: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_key, item_id, run_words, first_word (of the run in the item), changed_slots, kind (verbatim or reparameterised): one row for each document and item.

    ``numbers`` and ``units``: words (in lower case) that count as such besides those of NUMBER_WORDS and UNITS.
    """
    least = min(MIN_WORDS, window)
    items = columns_of(benchmark, ["item_id", "text"]).filter("text is not null").select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item"), "text").distinct()
    table = written(window_table(items.select("item", "text").dropDuplicates(["item"]), ["item"], (window,), None, least, numbers, units), "items")
    sizes = tuple(sorted(r.size for r in table.filter(F.col("template") != WHOLE).select("size").distinct().collect()))  # at most ``window`` of them
    rows = columns_of(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    hits = window_table(rows, ["doc_id", "text_key"], sizes or (window,), bitmap_of(table), least, numbers, units)
    hits = hits.select("doc_id", "text_key", F.col("n_words").alias("doc_words"), F.col("positions").alias("at"), "size", "hash", F.col("slots").alias("doc_slots"))
    whole = (F.col("template") != WHOLE) | (F.col("n_words") == F.col("doc_words"))
    met = hits.join(table, ["hash", "size"]).filter(whole)
    pairs = met.groupBy("doc_id", "text_key", "item", "n_words", "size").agg(F.collect_set(F.struct("template", "positions", "lengths", "slots", "at", "doc_slots")).alias("w"))
    found = pairs.withColumn("b", run_of(run, numbers, units)("w", "n_words")).filter("b.run is not null")
    best = found.groupBy("doc_id", "text_key", "item").agg(F.max("b").alias("b"))
    named = best.join(items.select("item", "item_id"), "item")
    return named.select("doc_id", "text_key", "item_id", F.col("b.run").alias("run_words"), (-F.col("b.first")).alias("first_word"), (-F.col("b.same")).alias("changed_slots"), F.when(F.col("b.same") == 0, "verbatim").otherwise("reparameterised").alias("kind"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """The documents that hold no item of the benchmark, all columns as they are."""
    found = written(leaks(docs, benchmark, window, run).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "leaks")
    rows, back = shielded(docs, ("doc_id", "text"))
    return back(rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_anti"))

from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirespark.llm import decontaminate as D

ITEM = "Anna has 12 apples and gives Bob 3 kg of them before 12 noon on that day"
BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, item_id string, hash long"


def found(spark, rows, items):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    return {(r.doc_id, r.item_id): (r.kind, r.run_words, r.changed_slots) for r in D.leaks(docs, spark.createDataFrame(items, BENCH)).collect()}


def test_templates(spark):
    rows = [
        (1, "foo bar. Clara has 15 apples and gives Dan 4 kg of them before 15 noon on that day, yes"),
        (2, "Clara has 15 apples and gives Dan 4 kg of them before 16 noon on that day, yes"),  # 12 became both 15 and 16
        (3, None), (4, ""), (None, ITEM), (5, "anna HAS 7 apples AND gives BOB 3 kg of them before 7 noon on that day"), (6, ITEM[:30]),
        (7, "word " * 50_000 + ITEM + " word" * 10), (7, "word " * 50_000 + ITEM + " word" * 10),
    ]
    got = found(spark, rows, [(1, ITEM)])
    assert got == {(1, 1): ("reparameterised", 17, 4), (None, 1): ("verbatim", 17, 0), (5, 1): ("reparameterised", 17, 1), (7, 1): ("verbatim", 17, 0)}


def test_short_items_whole_and_the_shortest_as_documents(spark):
    rows = [(1, "x the blue cat sat down y"), (2, "the blue cat sat up"), (3, "A b, c d."), (4, "a b c d e"), (5, "so a b c d")]
    assert set(found(spark, rows, [(1, "the blue cat sat down"), (2, "a b c d"), (3, None), (4, ""), (5, "A B C D")])) == {(1, 1), (3, 2), (3, 5)}


DENSE = "Alice Smith gave Bob Jones 12 kg and Carol White 30 kg while Dan Brown 7 m behind Eve Black lost 3 km"


def test_dense_slots(spark):
    other = "Yves Petit gave Zoe Moulin 15 kg and Xena Grand 31 kg while Will Court 8 m behind Vera Long lost 4 km"
    wrong = "Yves Petit gave Zoe Moulin 15 kg and Yves Grand 15 kg while Yves Court 15 m behind Yves Long lost 15 km"
    got = found(spark, [(1, DENSE), (2, f"he said {other} twice"), (3, wrong)], [(1, DENSE)])
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1][0] == "verbatim" and got[2, 1][0] == "reparameterised"


def test_numbers_in_words_of_other_languages_and_of_callers(spark):
    item = "Der Mann kauft zwölf Äpfel und gibt seiner Schwester drei davon vor dem Abend im Hof"
    docs = spark.createDataFrame([(1, item.replace("zwölf", "neun").replace("drei", "vier"))], "doc_id long, text string")
    assert D.leaks(docs, spark.createDataFrame([(1, item)], BENCH)).first().kind == "reparameterised"
    item = "she took une poignée of the red and blue stones that lay on the old table"
    docs = spark.createDataFrame([(1, item.replace("poignée", "zillion"))], "doc_id long, text string")
    assert D.leaks(docs, spark.createDataFrame([(1, item)], BENCH)).count() == 0
    assert D.leaks(docs, spark.createDataFrame([(1, item)], BENCH), numbers=("poignée", "zillion")).count() == 1


def test_run_has_to_be_long(spark):
    item = " ".join(f"w{i}x" for i in "abcdefghijklmnopqrstuvwxyz")
    words = item.split()
    rows = [(1, " ".join(words[3:16])), (2, " ".join(words[3:15])), (3, " ".join(words[:10] + ["zz"] + words[11:20]))]
    assert set(found(spark, rows, [(1, item), (1, item)])) == {(1, 1)}


FERRY = "The ferry left the harbour before dawn and crossed the wide bay in calm water. The crew sang."


def test_conflict_beyond_a_quotation(spark):
    quoted = "The ferry left the harbour before dawn and crossed the wide bay in calm water."
    rows = [
        (1, quoted + " She slept."),  # 'the' became both 'the' and 'she', but only beyond the quotation
        (2, "Anna has 15 apples and gives Bob 4 kg of them before 15 noon on that night 16 Anna"),
        (3, "The ferry left the harbour before dawn. She crossed the wide bay in calm water. The crew sang."),
    ]
    items = [(1, FERRY), (2, "Anna has 12 apples and gives Bob 3 kg of them before 12 noon on that night 12 Bob")]
    assert found(spark, rows, items) == {(1, 1): ("verbatim", 15, 0), (2, 2): ("reparameterised", 17, 2)}


def test_longest_run_restarts_after_a_conflict():
    same = {("a", "a")}
    assert D.longest([(0, same), (1, same), (2, {("a", "b")}), (3, set()), (4, set()), (5, {("a", "b")})], 8) == (11, -1, -2)
    assert D.longest([(0, {("the", "she")}), (1, set()), (2, {("the", "the")})], 8) == (9, 0, -1)
    assert D.longest([(0, {("12", "15")}), (1, set()), (2, {("12", "16")}), (3, set()), (4, set())], 8) == (10, -1, -2)
    assert D.longest([(3, {("a", "b"), ("a", "c")}), (4, same), (6, same)], 8) == (8, 0, -4)
    assert D.longest([(0, {("a", "b"), ("c", "b")})], 8) == (0, 0, 0) == D.longest([], 8)


def test_lists_of_numbers(spark):
    items = [(1, "What comes next in 2 4 8 16 32 64 128 256"), (2, "1 1 2 3 5 8"), (3, "Add 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg to the sum of all the others before noon")]
    rows = [(1, "so: what comes next in 2 4 8 16 32 64 128 256 then"), (2, "what comes next in 2 4 8 16 32 64 128 257"), (3, "x 1 1 2 3 5 8 y"), (4, "x 1 1 2 3 5 9 y"), (5, items[2][1])]
    assert found(spark, rows, items) == {(1, 1): ("verbatim", 12, 0), (2, 1): ("reparameterised", 12, 1), (3, 2): ("verbatim", 6, 0), (5, 3): ("verbatim", 22, 0)}


def brute(docs, items, run=13):
    grams = {}
    for i, t in items:
        w = (t or "").lower().split()
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        out |= {(d, i) for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def test_verbatim_against_brute_force(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()}
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert want and got == want


class Plain:
    """The definition word by word, without hashes: windows, diagonals, every interval of windows."""

    def __init__(self, text):
        self.words = [w.strip(".,").lower() for w in text.split()]
        self.number = [w.isdigit() for w in self.words]
        self.unit = [i > 0 and self.number[i - 1] and w in ("kg", "km") for i, w in enumerate(self.words)]
        self.name = [w[:1].isupper() for w in text.split()]

    def windows(self, size, kind):
        """(first, end) -> (words under the template, slot values)."""
        slot = [a or b or (kind == D.NAMES and c) for a, b, c in zip(self.number, self.unit, self.name)]
        fits = lambda i, j: j - i >= size and slot[i:j].count(False) >= (size + 1) // 2
        found = {}
        for i in range(len(slot)):
            for j in range(i + size, min(len(slot), i + 3 * size) + 1):
                if kind == D.EXACT:
                    if j == i + size and sum(slot[i:j]) * 2 > size:
                        found[i, j] = self.words[i:j]
                elif fits(i, j) and not (fits(i, j - 1) and fits(i + 1, j)) and (kind != D.NAMES or any(self.name[i:j])):
                    found[i, j] = [("<n>" if self.number[k] else "<u>" if self.unit[k] else "<p>") if slot[k] else self.words[k] for k in range(i, j)]
        return {(i, j): (shown, [self.words[k] for k in range(i, j) if slot[k]]) for (i, j), shown in found.items()}


def leaked(doc, item, run=13):
    """Whether any interval of windows on any diagonal is long enough; for texts in which no number comes twice."""
    d, b = Plain(doc), Plain(item)
    n, size = len(b.words), min(8, len(b.words))
    mine, theirs = ({k: t.windows(size, k) for k in (D.EXACT, D.PLAIN, D.NAMES)} for t in (b, d))
    for shift in range(-n, len(d.words)):
        for kinds, literal in (((D.EXACT, D.PLAIN), True), ((D.EXACT, D.PLAIN), False), ((D.EXACT, D.PLAIN, D.NAMES), False)):
            at = {}
            for k in kinds:
                for (i, j), w in mine[k].items():
                    x = theirs[k].get((i + shift, j + shift))
                    if x and w[0] == x[0] and (not literal or w[1] == x[1]):
                        end, pairs = at.get(i, (0, set()))
                        at[i] = (max(end, j), pairs | set(zip(w[1], x[1])))
            for i in at:
                j, pairs = i, set()
                while j in at:
                    pairs = pairs | at[j][1]
                    if not len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs):
                        break
                    if max(at[m][0] for m in range(i, j + 1)) - i >= min(run, n):
                        return True
                    j += 1
    return False


def sentence(rng, n, dense):
    numbers = iter(rng.sample(range(100, 1000), 60))
    words = []
    while len(words) < n:
        r = rng.random()
        words.append(str(next(numbers)) if r < dense / 2 else rng.choice("Ann Bob Cyd Dee Eva Fay Gus".split()) if r < dense else rng.choice("the old red cat sat by my low wall and ran".split()))
        if words[-1].isdigit() and rng.random() < 0.4:
            words.append(rng.choice(["kg", "km"]))
    return " ".join(words[:n])


def recast(rng, text):
    """Other numbers and names, each for one of the old."""
    fresh = iter(rng.sample(range(1000, 9000), 60))
    names = dict(zip("Ann Bob Cyd Dee Eva Fay Gus".split(), rng.sample("Pia Quin Ray Sue Tom Una Vic".split(), 7)))
    return " ".join(str(next(fresh)) if w.isdigit() else names.get(w, w) for w in text.split())


def test_recast_items_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randint(5, 30), rng.choice([0, 0.2, 0.5, 0.7]))) for i in range(60)]
    docs = []
    for k in range(160):
        words = rng.choice(items)[1].split()
        a, b = (0, len(words)) if k % 3 else sorted(rng.sample(range(len(words) + 1), 2))
        part = " ".join(words[a:b])
        part = part if k % 4 == 0 else recast(rng, part)
        if k % 5 == 0 and part:  # one word another
            spoilt = part.split()
            spoilt[rng.randrange(len(spoilt))] = "zzz"
            part = " ".join(spoilt)
        docs.append((k, " ".join(["yes so"] * (k % 2) + [part] + ["Hal wins big here"] * (k % 3))))
    want = {(d, i) for d, text in docs for i, item in items if leaked(text, item)}
    got = set(found(spark, docs, items))
    assert len(want) > 60 and got == want


def test_texts_that_repeat_themselves(spark):
    """As many windows meet as the product of both lengths; each pair is still one row, and what is best is found at once."""
    line = "the tide came in at 7 and Ann went home by the old road at 9 again and "
    items = [(1, "la " * 400), (2, line * 30), (3, "la di " * 9 + "end of it all now")]
    rows = [(1, "la " * 20_000), (2, "so " + line.replace("7", "5").replace("9", "8").replace("Ann", "Bea") * 1500), (3, "la di " * 5000), (4, "la la la la la la la la di")]
    took, began = [], time.time()
    for r in rows:
        took.append((found(spark, [r], items), time.time() - began))
        began = time.time()
    assert took[0][0] == {(1, 1): ("verbatim", 400, 0)} and took[0][1] < 30
    assert set(took[1][0]) == {(2, 2)} and took[1][0][2, 2][:2] == ("reparameterised", 30 * 18) and took[1][1] < 30
    assert took[2][0] == {(3, 3): ("verbatim", 18, 0)} and took[2][1] < 30
    assert took[3][0] == {}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=60), st.lists(st.sampled_from("abc"), min_size=13, max_size=40), st.sampled_from([1, 7, 2048]))
def test_best_run_against_every_pair_of_places(doc, item, part):
    """Over short alphabets, so that windows come again and again."""
    table, size = D.canonical(), 8
    mine, theirs = (D.grouped(D.windows(list(t), (size,), None, 5, table)) for t in (item, doc))
    met = [{"template": a[0], "positions": a[3], "lengths": a[4], "slots": a[5], "at": b[3], "doc_slots": b[5]} for a in mine for b in theirs if a[2] == b[2]]
    want = max([k for i in range(len(item)) for j in range(len(doc)) for k in [next(n for n in range(99) if item[i + n : i + n + 1] != doc[j + n : j + n + 1] or i + n >= len(item))] if k >= 13], default=None)
    old, D.PART = D.PART, part
    try:
        got = D.best_run(met, len(item), 13, table) if met else None
    finally:
        D.PART = old
    assert (got and got[0]) == want and (not got or got[1] == 0)


def test_drop_leaks(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (1, "another text", "b"), (None, None, "c"), (2, "fine", "d")], "doc_id long, text string, __id string")
    kept = D.drop_leaks(docs, spark.createDataFrame([(1, ITEM)], BENCH))
    assert kept.columns == docs.columns and sorted(r["__id"] for r in kept.select("`__id`").collect()) == ["b", "c", "d"]


@pytest.mark.parametrize("docs, items", [([], [(1, ITEM)]), ([(1, ITEM)], [])])
def test_empty(spark, docs, items):
    assert D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).count() == 0

"""Small worked examples of operators whose details matter."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quirespark import models, schema
from quirespark.functions import arrow as A
from quirespark.functions import text as T
from quirespark.operators import blocks as B
from quirespark.operators import chat as C
from quirespark.operators import library as L
from quirespark.operators import longdoc as D
from quirespark.operators import memory as M
from quirespark.operators import merge as G
from quirespark.operators import search as S
from quirespark.plans import front_door
from quirespark.sources import files as X
from quirespark.streaming import feed as P

LIST = [(0, 1, "Intro"), (1, 0, "p"), (2, 1, "Methods"), (3, 0, "a"), (4, 2, "Data"), (5, 0, "b"), (6, 0, None), (7, 1, "Results"), (8, 0, "c")]


@pytest.fixture
def listed(spark):
    return spark.createDataFrame([("d", i, lv, t, "u.png" if t is None else None) for i, lv, t in LIST], "k string, idx int, level int, text string, image_url string")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_word_score(spark):
    assert one(spark, T.word_score(F.col("t"), "graph graph net"), t="Graphic network") == 3
    assert one(spark, T.word_score(F.col("t"), ""), t="x") == 0


def test_domain_filter(spark):
    papers = spark.createDataFrame([(1, "a", "Math"), (2, "a", None), (3, "a", "bio"), (4, "a", "")], "id int, t string, domain string")
    assert {r.id for r in S.search_library(papers, "a", ["t"], "id", "math").collect()} == {1, 2, 4}


def test_heading_context(listed):
    found = {r.idx: r.context for r in B.heading_context(listed, "k").collect()}
    assert [found[i] for i in (0, 3, 4, 5)] == ["", "Methods", "Methods", "Data"]


def test_section(listed):
    assert [r.idx for r in B.section_scope(listed, "k", "method").orderBy("idx").collect()] == [2, 3, 4, 5, 6]
    row = B.section_text(listed, "k", "method").first()
    assert (row.paragraph_count, row.has_more, row.content) == (3, False, "a\nData\nb")
    assert B.section_scope(listed, "k", "zzz").count() == 0
    assert B.scoped(listed, "k", "zzz").count() == 9


def test_paragraph_context(spark, listed):
    targets = spark.createDataFrame([("d", 5)], "k string, target int")
    rows = B.paragraph_context(listed, "k", targets).orderBy("idx").collect()
    assert [(r.idx, r.is_target) for r in rows] == [(3, False), (4, False), (5, True), (7, False)]


def test_annotation_tokens():
    assert set(T.annotation_tokens("深度学习")) == {"深度学习", "深度学", "度学习", "深度", "度学", "学习"}
    assert T.annotation_tokens("a") == ["a"]


@pytest.mark.parametrize("sql, ok", [("select 1;", True), ("WITH x AS (SELECT 1) SELECT * FROM x", False), ("SELECT ';'", False), ("SELECT 1; SELECT 2", False), ("  select 2 ", True)])
def test_guard(spark, sql, ok):
    if ok:
        assert front_door.query(spark, sql).count() == 1
    else:
        with pytest.raises(front_door.Refused):
            front_door.guarded(sql)


def test_operations(spark):
    ops = front_door.Operations(one=lambda: spark.range(1), bad=lambda: 1 / 0)
    assert ops.call(spark, "one").count() == 1
    assert "unknown" in ops.call(spark, "two").first().error and "division" in ops.call(spark, "bad").first().error


def test_chunks(spark):
    text = "\n".join(["intro one two", "# A", "a b c", "d e f", "", "g h i j k l m", "# B"])
    got = B.chunks(spark.createDataFrame([(1, text)], "k int, text string"), "k", max_words=5).orderBy("chunk").collect()
    assert [r.text for r in got] == ["intro one two", "# A\na b c", "d e f\n", "g h i j k l m", "# B"]


def test_math_and_measurements():
    assert A.merged_math("$\na+b\n$") == "$$a+b$$" and A.merged_math("$\n$") == "$\n$" and A.merged_math("$\n$\nx") == "$\n$\nx"
    given = {r"$5\,\mathrm{m}$": "5m", "$CO_{2}$": "CO₂", "$10^{-3}$": "10⁻³", r"$x \in A$": r"$x \in A$", r"$\alpha$": r"$\alpha$"}
    assert {k: A.plain_measurements(k) for k in given} == given


def test_json_in():
    assert json.loads(A.json_in('x {a} then {"k": "}", "n": [1]} y')) == {"k": "}", "n": [1]}
    assert A.json_in("none", True) == "[]" and A.json_in("{ open") == "{}" and json.loads(A.json_in('t [1, "]"]', True)) == [1, "]"]


def test_arrow_columns(spark):
    row = spark.createDataFrame([("tide", "diet", "$5$")], "a string, b string, c string").select(A.similarity("a", "b").alias("s"), A.delatex("c").alias("d"), A.first_json(F.lit("{}")).alias("j")).first()
    assert (row.s, row.d, row.j) == (0.25, "5", "{}")


def test_reference_numbers(spark):
    for text, bare in {"[12] Smith": "Smith", "3. Foo": "Foo", "2020. Bar": "Bar", "(4) Z": "Z", "no": "no"}.items():
        assert one(spark, T.without_reference_number(F.col("t")), t=text) == bare


def test_classifier(spark):
    got = B.classified(spark.createDataFrame([(1, "## T\n#### U\n![a](u.png)\n\ntext")], "k int, text string"), "k").orderBy("idx").collect()
    assert [(r.type, r.level, r.text, r.url) for r in got] == [("heading", 2, "T", None), ("paragraph", 0, "#### U", None), ("image", 0, None, "u.png"), ("paragraph", 0, "text", None)]


def test_outline_paths(spark):
    rows = spark.createDataFrame([("d", i, lv, t) for i, (lv, t) in enumerate([(1, "A"), (3, "B"), (3, "C"), (2, "D")])], "k string, idx int, level int, text string")
    assert [r.path for r in B.outline_paths(rows, "k").orderBy("idx").collect()] == ["A", "A > B", "A > B > C", "A > D"]


def test_section_ends(spark):
    rows = spark.createDataFrame([("d", i, int(i in (0, 3, 5)), "t") for i in range(9)], "k string, idx int, level int, text string")
    assert [(r.start_index, r.end_index) for r in B.section_ends(rows, "k").orderBy("start_index").collect()] == [(0, 2), (3, 4), (5, 8)]


def test_acronyms(spark):
    text = "We use a polymerase chain reaction (PCR) and, in turn, long short term memory (LSTM-2) or (DNA)."
    got = M.acronyms(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("abbr").collect()
    assert [(r.abbr, r.definition) for r in got] == [("LSTM-2", "and, in turn, long short term memory"), ("PCR", "We use a polymerase chain reaction")]


def test_similarity():
    pairs = [("Attention is all you need", "Attention Is All You Need!", 0.98), ("tide", "diet", 0.25), ("diet", "tide", 0.5), ("x", "", 0.0)]
    assert [round(A.similarity_of(a, b), 2) for a, b, _ in pairs] == [s for *_, s in pairs]


def test_similar_titles_against_brute_force(spark):
    titles = ["red tide", "Red Tides", "tide", "diet", "", None, "\tRED TIDE\n", "red tide", "red tide", "blue moon", "tidered"]
    others = [None, "tide", "", "diets", "red", "blue", "tide", "blue tide", None, "red tide", "moon"]
    library = list(zip(range(len(titles)), titles, others))
    rows = spark.createDataFrame(library, "id bigint, title string, other string")
    asked = [(7, "red tide", None), (8, "tide", "blue moon"), (9, "Red tide", "red tide"), (10, "", ""), (11, None, None), (12, "zzz", "")]
    queries = spark.createDataFrame(asked, "query bigint, title string, other string")
    for most in (2, 5, 100):
        want = set()
        for q, *mine in asked:
            score = {i: max(A.similarity_of(a, b) for a in mine for b in own) for i, *own in library}
            near = sorted((-s, i) for i, s in score.items() if s >= 0.5)
            want |= {(q, i, -s) for s, i in near[:most]}
        got = [(r["query"], r.id, r.similarity) for r in S.similar_titles(rows, queries, "id", ["title", "other"], 0.5, most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert S.similar_titles(rows, queries.limit(0), "id", ["title"]).count() == 0
    assert S.similar_titles(rows.limit(0), queries, "id", ["title"]).count() == 0


def test_glossary(spark):
    user = spark.createDataFrame([("Loss", "s", "translate")], "foreign_term string, zh_term string, status string")
    domain = spark.createDataFrame([("loss", "x"), ("Epoch", "y")], "en_term string, zh_term string")
    assert {(r.en, r.status) for r in M.glossary(user, domain).collect()} == {("Loss", "translate"), ("Epoch", "translate")}


def test_boundary_match(spark):
    titles = spark.createDataFrame([(1, "the DNA."), (2, "cDNA"), (3, "dna-seq"), (4, "DNA_1"), (5, None)], "k int, text string")
    terms = spark.createDataFrame([("DNA",)], "en string")
    assert {r.k for r in M.term_matches(titles, "k", terms, whole_words=True).collect()} == {1, 3}
    assert {r.k for r in M.term_matches(titles, "k", terms).collect()} == {1, 2, 3, 4}


def test_term_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "TERMS", 3)
    terms = spark.createDataFrame([(f"t{i}",) for i in range(10)], "en string")
    docs = spark.createDataFrame([(i, f"a t{i} b") for i in range(10)], "k int, text string")
    assert {(r.k, r.en) for r in M.term_matches(docs, "k", terms).collect()} == {(i, f"t{i}") for i in range(10)}


def test_file_states(spark):
    source = spark.createDataFrame([(p, 1, "h", True) for p in "abcde"], "path string, size bigint, sha256 string, is_file boolean")
    target = spark.createDataFrame([("b", 1, "h", True), ("c", 2, "h", True), ("d", 1, "x", True), ("e", 1, "h", False)], source.schema)
    assert {r.path: r.state for r in G.file_differences(source, target).collect()} == {"a": "missing", "b": "identical", "c": "conflict", "d": "conflict", "e": "conflict"}


def test_insert_only(spark):
    target = spark.createDataFrame([(1, "loss")], "id int, term string")
    delta = spark.createDataFrame([(2, "loss"), (3, "epoch"), (4, "epoch")], target.schema)
    once = G.insert_only(target, delta, [["id"], ["term"]], "id")
    assert {r.id for r in once.collect()} == {1, 3}
    assert {r.id for r in G.insert_only(once, delta, [["id"], ["term"]], "id").collect()} == {1, 3}  # again changes nothing


def test_config_keys_always(spark):
    keys = spark.createDataFrame([("app_config", "[1]"), ("t", "[1]"), ("t", "[2]")], "table_name string, pk string")
    assert {(r.table_name, r.pk) for r in G.missing_keys(keys, keys.filter("pk = '[1]'")).collect()} == {("app_config", "[1]"), ("t", "[2]")}


def test_confirmed_terms(spark):
    terms = spark.createDataFrame([("x", None, "translate"), ("y", None, "never_translate"), ("z", "Z", "skip")], "en string, zh string, status string")
    assert [r.en for r in G.confirmed_terms(terms).collect()] == ["y"]


def test_strict_insert(spark):
    t = spark.createDataFrame([(1,)], "id int")
    assert G.insert_strict(t, spark.createDataFrame([(2,)], "id int"), ["id"]).count() == 2
    with pytest.raises(Exception, match="exists"):
        G.insert_strict(t, t, ["id"]).collect()


def roll(spark, states):
    rows = [(1, i, s, p) for i, (s, p) in enumerate(states)]
    r = D.parent_status(spark.createDataFrame(rows, "parent_job_id int, chapter_index int, status string, progress int")).first()
    return r.status, r.progress


def test_rollup(spark):
    assert roll(spark, [("completed", 100), ("translating", 50), ("pending", 0)]) == ("translating", 50)
    assert roll(spark, [("completed", 100), ("failed", 0), ("waiting_term_review", 0)])[0] == "failed"
    assert roll(spark, [("completed", 100)]) == ("completed", 100)


def test_chapter_ranges(spark):
    marks = spark.createDataFrame([("d", 1, 1, "a", 20), ("d", 1, 5, "b", 20), ("d", 1, 5, "c", 20), ("d", 1, 12, "d", 20), ("d", 2, 3, "x", 20)], "k string, level int, page int, title string, page_count int")
    assert [(r.start_page, r.end_page) for r in D.chapters(marks, "k").orderBy("start_page", "title").collect()] == [(1, 4), (5, 5), (5, 11), (12, 20)]


@pytest.mark.parametrize("ranges, bad", [([(1, 3), (3, 5)], 1), ([(1, 3), (4, 5)], 0), ([(1, 9)], 1), ([(3, 2)], 1)])
def test_range_errors(spark, ranges, bad):
    rows = spark.createDataFrame([("d", a, b, 5) for a, b in ranges], "k string, start_page int, end_page int, page_count int")
    assert D.range_errors(rows, "k").count() == bad


def test_uncovered(spark):
    rows = spark.createDataFrame([("d", 1, 2), ("d", 4, 4)], "k string, start_page int, end_page int")
    docs = spark.createDataFrame([("d", 5)], "k string, page_count int")
    assert sorted(r.page for r in D.uncovered(rows, docs, "k").collect()) == [3, 5]


def test_merge_children_needs_all(spark):
    rows = spark.createDataFrame([(1, 0, "a", [(0, "x")], ["r", "", "r"]), (2, 0, "a", None, None)], "p int, chapter_index int, title string, body array<struct<level:int,text:string>>, refs array<string>")
    got = D.merged_children(rows, "p").collect()
    assert [(r.p, [tuple(b) for b in r.body], r.refs) for r in got] == [(1, [(1, "a"), (0, "x")], ["r"])]


@pytest.mark.parametrize("roles, first", [("uauauau", 2), ("uau", 0)])
def test_recent(spark, roles, first):
    rows = spark.createDataFrame([("s", i, {"u": "user", "a": "assistant"}[r], "x") for i, r in enumerate(roles)], "k string, turn int, role string, content string")
    assert min(r.turn for r in C.with_recent(rows, "k").filter("recent").collect()) == first


def test_snip_shapes(spark):
    content = json.dumps({"matches": [{"heading_context": "H", "block_idx": 4}, {"heading_context": "H"}], "pad": "x" * 300})
    rows = spark.createDataFrame([("s", 0, "tool", content), *[("s", i, "user", "q") for i in range(1, 5)]], "k string, turn int, role string, content string")
    got = json.loads(C.snipped(rows, "k").filter("turn = 0").first().content)
    assert got["找到"] == "2处匹配" and got["章节"] == ["H"]


def test_micro(spark):
    kind = "k string, turn int, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"
    rows = [("s", 0, "assistant", "", [("c1", "find", "q=1"), ("c2", "get", "")], None), ("s", 1, "tool", "found it", None, "c1"), *[("s", i, "user", "q", None, None) for i in range(2, 6)]]
    got = C.micro(spark.createDataFrame(rows, kind), "k").orderBy("turn").collect()
    assert [r.turn for r in got] == [0, 2, 3, 4, 5] and got[0].content == "[工具调用] find(q=1) → found it\n[工具调用] get() → "


def test_snippet(spark):
    text = "x" * 100 + "needle" + "y" * 394
    assert one(spark, T.snippet(F.col("t"), "NEEDLE"), t=text) == text[50:300]


def test_changes(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, 1, 2, 1])], "k int, seq int, s int")
    assert sorted(r.seq for r in P.changes(rows, "k", ["seq"], ["s"]).collect()) == [0, 2, 3]


def test_streaming_feed(spark, tmp_path):
    rows = [("a", 1, "run", 1, "s", "r"), ("a", 2, "run", 1, "s", "r"), ("a", 3, "run", 2, "s", "r"), ("b", 1, "completed", 100, "s", "r"), ("b", 2, "run", 1, "s", "r")]
    log = spark.createDataFrame(rows, P.FEED)
    log.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = P.progress_feed(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    told = {(r.job_id, r.seq, r.result_id) for r in spark.table("feed").collect()}
    assert told == {("a", 1, None), ("a", 3, None), ("b", 1, "r")} == {(r.job_id, r.seq, r.result_id) for r in P.batch_feed(log).collect()}


def test_tables_are_restored(spark, tmp_path):
    path = str(tmp_path / "t")
    X.replace_table(spark.range(3), path, 1)
    now, version, wrong = X.replaced_or_restored(spark.range(5), path, 1)
    assert (now.count(), version, wrong) == (5, 2, None)
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    now, version, wrong = X.replaced_or_restored(bad, path, 2)
    assert (now.count(), version) == (5, 2) and "no" in wrong
    with pytest.raises(Exception, match="EXISTS"):
        X.replaced_or_restored(spark.range(7), path, 1)
    assert X.restored_table(spark, path, 2).count() == 5


def test_pages_are_clamped_once(spark):
    rows = spark.range(350)
    assert [r.id for n in (1, 2, 3, 4) for r in L.page(rows, n, 200, F.col("id")).collect()] == list(range(350))


def test_deep_folders(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)], "id int, parent_id int")
    assert {(r.id, r.depth) for r in L.subtree(rows, 4).collect()} == {(i, i - 3) for i in range(4, 30)}


def test_gaps(spark):
    rows = spark.createDataFrame([("d", 3, 4), ("d", 4, 9), ("d", 5, 6), ("d", 12, 11), ("e", 1, 50)], "k string, start_page int, end_page int")
    docs = spark.createDataFrame([("d", 12), ("e", 5), ("f", 2), ("g", 0)], "k string, page_count int")
    assert {(r.k, r.first, r.last) for r in D.gaps(rows, docs, "k").select("k", F.col("first"), F.col("last")).collect()} == {("d", 1, 2), ("d", 10, 12), ("f", 1, 2)}


def test_citation_numbers(spark):
    assert one(spark, T.citation_numbers(F.col("t")), t="x [1,2],[3]") == [1, 2, 3]


def test_masks_authors_ids(spark):
    assert [one(spark, T.masked(F.col("t")), t=v) for v in ("abcdef", "abc", "")] == ["abcd**", "abc", ""]
    assert one(spark, T.author_list(F.col("t")), t="A, B；C、 ") == ["A", "B", "C"]
    assert [one(spark, T.block_number(F.col("t")), t=v) for v in ("p-10", "h-1", None)] == [10, 1, 0]
    assert one(spark, T.without_fence(F.col("t")), t='```json\n"a"\n```') == "a"


def test_blocks_from_json(spark):
    body = {"正文": [{"标题等级": 1, "文本": "H"}, {"图片地址": "u"}], "参考文献": ["r1", "r2"]}
    rows = spark.createDataFrame([("r", "j", "p", json.dumps(body), None)], schema.RESULTS)
    got = schema.blocks(rows).orderBy("block_idx").collect()
    assert [(b.block_idx, b.level, b.text_en, b.image_url) for b in got] == [(0, 1, "H", None), (1, 0, None, "u")]
    assert [r.text for r in schema.references(rows).orderBy("pos").collect()] == ["r1", "r2"]


def test_files(spark, tmp_path):
    import hashlib
    import zipfile

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"abc")
    with zipfile.ZipFile(tmp_path / "f" / "d.zip", "w") as z:
        z.writestr("a/full.md", "# T\n![](images/i.png)")
        z.writestr("images/i.png", b"\x89")
    got = X.inventory(spark, str(tmp_path / "f"), "*.bin").first()
    assert got["size"] == 3 and got.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert X.parsed_archives(spark, str(tmp_path / "f")).first().markdown.startswith("# T")
    assert [(r.name, bytes(r.content)) for r in X.archive_images(spark, str(tmp_path / "f")).collect()] == [("images/i.png", b"\x89")]
    links = spark.createDataFrame([(1, 0, "papers/9/i.png", "/u/i.png")], "k int, pos int, name string, url string")
    docs = spark.createDataFrame([(1, "a ![x](images/i.png) b (c)")], "k int, text string")
    assert X.relinked_images(docs, links, "k").first().text == "a ![x](/u/i.png) b (c)"
    long = spark.createDataFrame([(1, f"![{'t' * 2500}](images/i.png)(images/i.png) ![](other.png)![]() images/i.png"), (2, "![x](images/i.png)"), (3, None)], "k int, text string")
    assert {r.k: r.text for r in X.relinked_images(long, links, "k").collect()} == {1: f"![{'t' * 2500}](/u/i.png)(images/i.png) ![](other.png)![]() images/i.png", 2: "![x](images/i.png)", 3: None}


def test_models(spark):
    class Broken:
        def ask(self, task, text):
            raise OSError

    rows = spark.createDataFrame([(1, "$5$ m")], "k int, text string")
    assert models.clean(rows, ["k"], models.Stub()).first().cleaned == "5 m"
    assert models.translate(rows, ["k"], Broken()).first().translation == ""
    assert models.terms(rows, ["k"], Broken()).first().terms == "[]"
    assert models.verdicts(rows, ["k"], models.Stub()).first().verdict == "[]"


def test_library_filter(spark):
    papers = spark.createDataFrame([("a_c", None, 2000, "p", "normal"), ("abc", "Z", 2001, "p", "normal"), ("abc", None, 2000, "p", "long_chapter")], "title string, title_zh string, year int, paper_type string, document_role string")
    assert L.library_filter(papers, "A_C").count() == 1 and L.library_filter(papers, "A_C", wildcards=True).count() == 2 and L.library_filter(papers, "z").count() == 1


def test_memory_and_passage_context(spark):
    lines = [(0, 1, "Intro"), (1, 0, "alpha one"), (2, 1, "Methods"), (3, 0, "beta two"), (4, 2, "Data"), (5, 0, "gamma three")]
    blocks = spark.createDataFrame([(1, i, level, text, None) for i, level, text in lines], "k int, idx int, level int, text string, image_url string")
    docs = spark.createDataFrame([(1, "red tide rises, red tide falls"), (2, None)], "k int, text string")
    rows = {r.k: r for r in M.memory(blocks, docs, "k").collect()}
    assert [(s.start_index, s.end_index, s.path, s.summary) for s in rows[1].sections] == [(0, 1, "Intro", "alpha one"), (2, 3, "Methods", "beta two"), (4, 5, "Methods > Data", "gamma three")]
    assert [(o.idx, o.path) for o in rows[1].outline] == [(0, "Intro"), (2, "Methods"), (4, "Methods > Data")]
    assert [(p.phrase, p.n) for p in rows[1].phrases] == [("red tide", 2)]
    assert rows[2].outline is None and rows[2].phrases is None
    context = {r.idx: (r.path, r.gist, r.previous or "", r.next or "") for r in M.passage_context(blocks, "k").collect()}
    assert context[1] == ("Intro", "alpha one", "Intro", "Methods")
    assert context[3] == ("Methods", "beta two", "Methods", "Data")
    assert context[5] == ("Methods > Data", "gamma three", "Data", "")
    texts = "the red tide in a red tide model (RTM)\nRTM is x_1 and $a+b$ here\nno more"
    docs = spark.createDataFrame([(1, texts)], "k int, text string")
    blocks = spark.createDataFrame([(1, i, 0, t, None) for i, t in enumerate(texts.split("\n"))], blocks.schema)
    held = {r.idx: ([list(x) if not isinstance(x, str) else x for x in r.acronyms], r.symbols, r.phrases) for r in M.passage_context(blocks, "k", docs=docs).collect()}
    assert held[1] == (["RTM = the red tide in a red tide model"], ["a+b", "x_1"], []) and held[0][2] == ["red tide"] and held[2] == ([], [], [])

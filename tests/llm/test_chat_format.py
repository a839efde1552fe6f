from __future__ import annotations

import pytest

from quirespark.llm import chat_format as C
from quirespark.llm import queries

from .. import oracle

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = {}
    for c, t, r, x in rows:
        role = (r or "").replace("\n", " ").replace("\r", " ").strip(" ") or "unknown"
        said.setdefault(c, []).append((t is not None, t or 0, role.replace("<|", "< |"), (x or "").replace("<|", "< |")))
    out = []
    for c, m in said.items():
        for p in {r for *_, r, _ in m if r != "system"}:
            text, spans = "", []
            for *_, r, x in sorted(m):
                text += C.BEGIN + ("system" if r == "system" else "assistant" if r == p else f"user name={r}") + "\n"
                at = len(text)
                text += x + C.END
                if r == p:
                    spans.append(f"{at}-{len(text)}")
                text += "\n"
            out.append((c, p, len(m), text, ",".join(spans), sum(int(s.split("-")[1]) - int(s.split("-")[0]) for s in spans)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


ROWS = [(1, None, None, None), (1, 0, "user", "<|begin|>x"), (1, 0, "user", "<|begin|>x"), (1, 0, "user", "y"), (None, 3, "a", "b"), (2, 600, "bob", "hé\n😀"), (2, 1, "system", "sys"), (2, 2, "eve", ""), (2, 3, " ", "z"), (2, None, "bob", "yes"), (2, None, "bob", "yes"), (3, 1, "system", "only"), (4, 0, "a\nb<|", "line"), (4, -5, "c", "first")]


def test_against_brute_force(spark):
    assert found(C.rotated(spark.createDataFrame([(*r, 1, "x") for r in ROWS], KIND + ", part int, said string"))) == brute(ROWS)


def long_talk():
    return [(1, None if i % 5 == 0 else i // 2, "system" if i == 3 else f"s{i % 3}", "word " * (i % 4)) for i in range(2000)] + [(2, 0, "s0", "hello")]


def test_long_conversation_is_whole(spark):
    got = found(C.rotated(spark.createDataFrame(long_talk(), KIND)))
    assert got == brute(long_talk()) and len(got) == 4


def test_long_conversation_as_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(long_talk() + ROWS, KIND).coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    oracle.same(C.rotated(spark.read.parquet(str(tmp_path / "c"))), con, C.ROTATED_SQL)


def test_parts_make_the_whole(spark):
    rows = long_talk() + ROWS
    got = C.parts(spark.createDataFrame(rows, KIND), 100).collect()
    assert max(r.n_messages for r in got) == 100
    whole = {}
    for r in sorted(got, key=lambda r: r.part):
        n, text, mask, trained = whole.get((r.conv_id, r.perspective), (0, "", [], 0))
        assert r.begin == len(text)
        whole[r.conv_id, r.perspective] = (n + r.n_messages, text + r.rendered, mask + ([r["mask"]] if r["mask"] else []), trained + r.n_trained)
    assert sorted(((*k, n, t, ",".join(m), c) for k, (n, t, m, c) in whole.items()), key=repr) == brute(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "a", "x" * 2_000_000), (1, 1, "b", "y")]
    assert found(C.rotated(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_many_messages_without_a_conversation(spark):
    rows = [(None, i % 3000, "a" if i % 2 else "b", f"t{i}") for i in range(6000)] + [(1, 0, "a", "x")]
    got = C.parts(spark.createDataFrame(rows, KIND), 64).collect()
    assert max(r.n_messages for r in got) == 64 and sum(r.n_messages for r in got if r.conv_id is None and r.perspective == "a") == 6000


@pytest.mark.parametrize("name", ["op6_perspective_rotation", "perspective_parts"])
def test_same_as_sql(spark, small, name):
    oracle.same(queries.queries()[name](spark, small), oracle.connect(small), queries.oracle_sql()[name])


def test_no_python(spark, small, capsys):
    C.rotated(spark.read.parquet(f"{small}/conversations.parquet")).explain()
    assert "Python" not in capsys.readouterr().out


def test_empty(spark):
    assert C.rotated(spark.createDataFrame([], KIND)).count() == 0
    assert C.parts(spark.createDataFrame([], KIND)).count() == 0

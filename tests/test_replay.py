from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from quirespark.operators import chat as C
from quirespark.operators import replay as R

SCHEMA = "k long, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_call_id string"


def ask(text: str) -> str | None:
    return f"sum {len(text)}" if len(text) % 3 else None


def cutoff(history, recent):
    seen = 0
    for i in range(len(history) - 1, -1, -1):
        seen += history[i]["role"] == "user"
        if seen == recent:
            return i
    return 0


def compressed(history, failures, own, index):
    """One compression of a whole history, level by level, as new lists."""
    history = [dict(m) for m in history if m["role"] != "system"]
    if failures >= own.failures:
        return history, None, failures, "none"
    users, at = sum(m["role"] == "user" for m in history), cutoff(history, own.recent)
    if sum(len(m["content"]) for m in history) > own.emergency:
        return [{"role": "system", "content": R.DROPPED}] + history[at:], None, failures, "emergency"
    summary, level = None, "none"
    if users > own.snip:
        level = "snip"
        history = [m | {"content": index[m["content"]]} if i < at and m["role"] == "tool" and len(m["content"]) > own.longest else m for i, m in enumerate(history)]
    if users > own.micro:
        level, out, skip = "micro", [], 0
        for i, m in enumerate(history):
            if i < skip:
                continue
            if i < at and m["role"] == "assistant" and m.get("calls") and not m["content"]:
                j, found = i + 1, {}
                while j < len(history) and history[j]["role"] == "tool" and history[j].get("id") in [c[0] for c in m["calls"]]:
                    found[history[j]["id"]] = history[j]["content"][: own.snippet]
                    j += 1
                m, skip = {"role": "assistant", "content": "\n".join(f"[工具调用] {n}({a}) → {found.get(c, '')}" for c, n, a in m["calls"])}, j
            out.append(m)
        history = out
    if users > own.fold:
        level, at = "fold", cutoff(history, own.recent)
        history = [m | {"content": m["content"][: own.kept] + "…"} if i < at and m["role"] in ("user", "assistant") and not m.get("calls") and len(m["content"]) > own.kept else m for i, m in enumerate(history)]
    if users > own.auto:
        level, at = "auto", cutoff(history, own.recent)
        if at:
            summary = ask("\n".join(f"{m['role']}: {m['content'][: own.each]}" for m in history[:at] if m["role"] in ("user", "assistant") and m["content"]))
            if summary is None:
                failures += 1
            else:
                failures, history = 0, [{"role": "system", "content": f"{C.SUMMARY}\n{summary}"}] + history[at:]
    return history, summary, failures, level


def plain(rows, failed, own, index):
    out = {}
    for k in {r[0] for r in rows}:
        said = sorted([r for r in rows if r[0] == k], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] or ""))
        answers = []
        for r in said:
            if not answers or r[2] == "user":
                answers.append([])
            answers[-1].append({"role": r[2], "content": r[3] or "", "calls": [tuple(c) for c in r[4] or []], "id": r[5]})
        history, failures, last, level = [], failed.get(k, 0), None, "none"
        for a in answers:
            history, summary, failures, level = compressed(history + a, failures, own, index)
            last = summary or last
        out[k] = ([(m["role"], m["content"]) for m in history], failures, last, level)
    return out


def found(rows) -> dict:
    got: dict = {}
    for r in rows:
        got.setdefault(r.k, []).append(r)
    return {k: ([(r.role, r.content) for r in sorted(v, key=lambda r: r.position)], v[0].failures, v[0].summary, v[0].level) for k, v in got.items()}


def conversation(rng, k, turns):
    rows, t = [(k, None, "system", "You help.", None, None)], 0
    for i in range(turns):
        rows.append((k, t := t + 1, "user", f"ask {i} " + "q" * rng.choice([3, 160]), None, None))
        for _ in range(rng.randint(0, 2)):
            ids = [f"c{rng.randrange(9)}" for _ in range(rng.randint(1, 2))]
            rows.append((k, t := t + 1, "assistant", rng.choice(["", None, "let me see"]), [(c, "search", '{"q": 1}') for c in ids], None))
            for c in ids:
                result = rng.choice([json.dumps({"matches": [{"heading_context": "h" * 90 + str(x), "block_idx": x} for x in range(5)]}), "plain " * 60, "short"])
                rows.append((k, t := t + 1, "tool", result, None, rng.choice([c, "other"])))
        rows.append((k, t := t + 1, "assistant", "answer " * rng.choice([2, 40]), None, None))
    return rows


def test_against_whole_histories(spark):
    rng = random.Random(11)
    rows = [r for k in range(40) for r in conversation(rng, k, rng.randint(1, 24))] + conversation(rng, None, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    texts = df.select("content").where("length(content) > 200").distinct()
    once = texts.select("content", C.index_of(F.col("content")).alias("once"))
    index = {r.content: r.once for r in once.collect()} | {r.once: r.twice for r in once.select("once", C.index_of(F.col("once")).alias("twice")).collect()}
    failed = {3: 2, 4: 3, 5: 1}
    sessions = spark.createDataFrame([(k, n) for k, n in failed.items()], "k long, compact_failures int")
    levels = set()
    for own in (R.Limits(), R.Limits(snip=1, micro=2, fold=3, auto=4, emergency=2500, recent=2)):
        got = found(R.replayed(df, sessions, "k", ask, own).collect())
        assert got == plain(rows, failed, own, index)
        levels |= {v[3] for v in got.values()}
    assert levels == {"none", "snip", "micro", "fold", "auto", "emergency"}


def test_one_long_session_keeps_a_short_history(spark):
    rows = spark.range(30_000).selectExpr("7L as k", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id) as content")
    got = R.replayed(rows, spark.createDataFrame([], "k long, compact_failures int"), "k", lambda t: "s").collect()
    assert len(got) < 40 and got[0].k == 7


def test_empty(spark):
    assert R.replayed(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "k long, compact_failures int"), "k", ask).count() == 0

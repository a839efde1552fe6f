"""The compression of a conversation as it happens: after every answer the levels that are due are applied to what the answers before have left.

A session is read once, in order, and only its working history is held, which the levels keep short; so a session may be of any length. What a result of a tool becomes when it is cut to its index is worked out
by built-in functions before; the fold only chooses. A summary is asked for when it is due, and the result is written before anyone reads it, so nothing is asked twice.

Defined results: messages are in the order of ``turn`` (a null first), then role and content. An answer ends where the next message of the user begins, or the session ends. Sessions without a row of their own have no failures.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..stored import stored
from . import chat as C

DROPPED = "[earlier messages dropped]"


@dataclass(frozen=True)
class Limits:
    """User turns above which a level starts, characters above which only recent turns stay, failures that stop it all, recent user turns, and lengths above which texts are cut."""

    snip: int = C.SNIP
    micro: int = C.MICRO
    fold: int = C.FOLD
    auto: int = C.AUTO
    emergency: int = C.EMERGENCY
    failures: int = C.FAILURES
    recent: int = 3
    longest: int = 200
    kept: int = 150
    snippet: int = 50
    each: int = 400


@dataclass
class Message:
    """A message, what it would be as an index, and that index cut again. ``calls``: (id, name, arguments)."""

    role: str
    content: str
    cut: tuple[str, ...] = ()
    calls: tuple[tuple[str, str, str], ...] = ()
    answers: str = ""


class Session:
    """The working history of one session."""

    def __init__(self, limits: Limits, failures: int, ask):
        self.limits, self.failures, self.ask = limits, failures, ask
        self.history: list[Message] = []
        self.summary: str | None = None
        self.level = "none"

    def users(self) -> int:
        return sum(m.role == "user" for m in self.history)

    def old(self) -> int:
        """How many messages come before the recent turns."""
        places = [i for i, m in enumerate(self.history) if m.role == "user"]
        return places[-self.limits.recent] if len(places) >= self.limits.recent else 0

    def answered(self) -> None:
        """Applies what is due to all but messages of the system, which do not last beyond an answer: a summary is the session's own."""
        self.history = [m for m in self.history if m.role != "system"]
        own, n = self.limits, self.users()
        if self.failures >= own.failures:
            self.level = "none"
        elif sum(len(m.content) for m in self.history) > own.emergency:
            self.level, self.history = "emergency", [Message("system", DROPPED), *self.history[self.old() :]]
        else:
            due = [(name, step) for name, least, step in (("snip", own.snip, self.snip), ("micro", own.micro, self.micro), ("fold", own.fold, self.fold), ("auto", own.auto, self.auto)) if n > least]
            self.level = due[-1][0] if due else "none"
            for _, step in due:
                step()

    def snip(self) -> None:
        for m in self.history[: self.old()]:
            if m.role == "tool" and m.cut and len(m.content) > self.limits.longest:
                m.content, m.cut = m.cut[0], m.cut[1:]

    def micro(self) -> None:
        old, made, i = self.old(), [], 0
        while i < old:
            m = self.history[i]
            i += 1
            if m.role == "assistant" and m.calls and not m.content:
                found, wanted = {}, {c[0] for c in m.calls}
                while i < len(self.history) and self.history[i].role == "tool" and self.history[i].answers in wanted:
                    found[self.history[i].answers] = self.history[i].content[: self.limits.snippet]
                    i += 1
                m = Message("assistant", "\n".join(f"[工具调用] {name}({arguments}) → {found.get(c, '')}" for c, name, arguments in m.calls))
            made.append(m)
        self.history = made + self.history[i:]

    def fold(self) -> None:
        for m in self.history[: self.old()]:
            if m.role in ("user", "assistant") and not m.calls and len(m.content) > self.limits.kept:
                m.content = m.content[: self.limits.kept] + "…"

    def auto(self) -> None:
        old = self.history[: self.old()]
        if not old:
            return
        told = self.ask("\n".join(f"{m.role}: {m.content[: self.limits.each]}" for m in old if m.role in ("user", "assistant") and m.content))
        if told is None:
            self.failures += 1
        else:
            self.failures, self.summary = 0, told
            self.history = [Message("system", f"{C.SUMMARY}\n{told}"), *self.history[len(old) :]]


RESULT = "position int, role string, content string, failures int, summary string, level string"


def replayed(messages: DataFrame, sessions: DataFrame, key: str, ask, limits: Limits = Limits()) -> DataFrame:
    """key, position, role and content of every message that a session is left with, and with each the session's failures, last summary (or null) and the level that was applied last.

    messages: key, turn, role, content and, if there are tools, tool_calls (array of id, name, arguments) and tool_call_id. ``ask``: a function from a text to its summary, None for a failure.
    """
    has = set(messages.columns)
    content = T.first_text("content")
    index = C.index_of(F.col("content"))
    cut = F.when((F.col("role") == "tool") & (F.length("content") > limits.longest), F.array(F.col("once"), F.when(F.length("once") > limits.longest, C.index_of(F.col("once")))))
    calls = F.col("tool_calls") if "tool_calls" in has else F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>")
    rows = messages.select(F.col(key).cast("string").alias("__key"), "turn", "role", content.alias("content"), calls.alias("calls"), (F.col("tool_call_id") if "tool_call_id" in has else F.lit(None).cast("string")).alias("answers"))
    rows = rows.withColumn("once", F.when((F.col("role") == "tool") & (F.length("content") > limits.longest), index)).withColumn("cut", cut).drop("once")
    failed = sessions.select(F.col(key).cast("string").alias("__of"), F.coalesce("compact_failures", F.lit(0)).alias("failures"))
    joined = rows.join(failed, F.col("__key").eqNullSafe(F.col("__of")), "left").drop("__of")
    ordered = joined.repartition("__key").sortWithinPartitions("__key", "turn", "role", "content")
    kind = dict(messages.dtypes)[key]

    def rows_of(name, session: Session) -> pd.DataFrame:
        session.answered()
        own = session.history
        return pd.DataFrame({key: [name] * len(own), "position": range(len(own)), "role": [m.role for m in own], "content": [m.content for m in own], "failures": session.failures, "summary": session.summary, "level": session.level})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, session = None, None
        for frame in frames:
            for r in frame.itertuples(index=False):
                name = r[0]
                if session is None or name != now:
                    if session:
                        yield rows_of(now, session)
                    now, session = name, Session(limits, 0 if r.failures != r.failures or r.failures is None else int(r.failures), ask)
                elif r.role == "user":
                    session.answered()
                cut = tuple(x for x in r.cut if x is not None) if r.cut is not None else ()
                asked = tuple((c["id"] or "", c["name"] or "unknown", c["arguments"] or "") for c in r.calls) if r.calls is not None else ()
                session.history.append(Message(r.role or "", r.content, cut, asked, r.answers or ""))
        if session:
            yield rows_of(now, session)

    found = stored(ordered.mapInPandas(run, f"{key} string, {RESULT}"), "replay")
    return found.withColumn(key, F.col(key).cast(kind))

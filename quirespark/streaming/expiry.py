"""What is open for a while: requests and tokens for 15 minutes, operations for two hours, as a stream with timers and at rest.

Defined results: opening again begins a new term; closing what isn't open, or what has expired, says nothing. Of events at one time, openings come first. An unknown kind lasts as long as a request.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How long each kind lasts, in seconds.
TERMS = {"request": 900, "token": 900, "operation": 7200}
EVENTS = "key string, kind string, at bigint, closes boolean"
TOLD = "key string, kind string, event string, at bigint"


class _Terms(StatefulProcessor):
    """Holds what is open with the time at which its term ends; a timer tells when nobody has closed it. ``clock``: times are those of the engine, or else of the events."""

    def __init__(self, terms: dict[str, float], clock: bool):
        self.terms, self.clock = terms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "kind string, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["at", "closes"])
        held = tuple(self.open.get()) if self.open.exists() else None
        was, out = held, []
        for kind, at, closes in frame[["kind", "at", "closes"]].itertuples(index=False):
            now = timer_values.getCurrentProcessingTimeInMs() if self.clock else int(at)
            if held and held[1] < now:
                out.append((key[0], held[0], "expired", held[1]))
                held = None
            if not closes:
                held = (kind, now + int(1000 * self.terms.get(kind, self.terms["request"])))
                out.append((key[0], kind, "opened", now))
            elif held:
                out.append((key[0], held[0], "closed", now))
                held = None
        if was != held:
            if was:
                self.handle.deleteTimer(was[1] + 1)
            if held:
                self.open.update(held)
                self.handle.registerTimer(held[1] + 1)
            else:
                self.open.clear()
        yield pd.DataFrame(out, columns=["key", "kind", "event", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.open.exists() and (held := tuple(self.open.get()))[1] < expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], held[0], "expired", held[1]))
            self.open.clear()
        yield pd.DataFrame(out, columns=["key", "kind", "event", "at"])

    def close(self) -> None:
        pass


def expiring(events: DataFrame, terms: dict[str, float] | None = None, by_event: str | None = None) -> DataFrame:
    """key, kind, event (opened, closed, expired) and at (milliseconds) of a stream of ``EVENTS``.

    Terms run by the clock of the engine; with ``by_event``, a column of times with a watermark, by that of the events.
    """
    processor = _Terms(terms or TERMS, by_event is None)
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=TOLD, outputMode="Append", timeMode="ProcessingTime" if by_event is None else "EventTime")


def at_rest(events: DataFrame, now: Column | int, terms: dict[str, float] | None = None) -> DataFrame:
    """The same of a table of ``EVENTS``, by the times of events, as it stands at ``now`` (milliseconds)."""
    lasting = terms or TERMS
    term = F.coalesce(*[F.when(F.col("kind") == k, int(1000 * v)) for k, v in lasting.items()], F.lit(int(1000 * lasting["request"])))
    order = W.partitionBy("key").orderBy("at", "closes")
    end = F.when(~F.col("closes"), F.col("at") + term)
    own = events.withColumn("until", end).withColumn("next_at", F.lead("at").over(order)).withColumn("next_closes", F.lead("closes").over(order))
    # what a closing event closes is the event right before it, if that opens and its term hasn't ended
    opened = own.filter(~F.col("closes"))
    late = F.coalesce(F.col("next_at") > F.col("until"), F.lit(now) > F.col("until"))
    each = F.array(
        F.struct(F.lit("opened").alias("event"), F.col("at").alias("at")),
        F.when(late, F.struct(F.lit("expired").alias("event"), F.col("until").alias("at"))).when(F.col("next_closes"), F.struct(F.lit("closed").alias("event"), F.col("next_at").alias("at"))),
    )
    told = opened.select("key", "kind", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e"))
    return told.select("key", "kind", "e.event", "e.at")

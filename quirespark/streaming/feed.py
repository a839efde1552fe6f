"""Progress feeds: a change log of jobs in, only changes out, until a job ends; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = ("status", "progress", "current_stage")
ENDED = ("completed", "failed", "waiting_term_review")
FEED = "job_id string, seq bigint, status string, progress int, current_stage string, result_id string"


def changes(log: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """Rows whose state differs from that of the row before; nulls count as values."""
    w = W.partitionBy(key).orderBy(*order)
    before = log.withColumn("__was", F.lag(F.struct(*state)).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return before.filter(F.col("__first") | ~F.col("__was").eqNullSafe(F.struct(*state))).drop("__was", "__first")


class _OnlyChanges(StatefulProcessor):
    """Keeps the last state of a job for a while; passes on what differs, and nothing after its end."""

    def __init__(self, keep_hours: int):
        self.keep = keep_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, status string, progress int, current_stage string", ttlDurationMs=self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        frame = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get() if self.last.exists() else None
        out = []
        for seq, status, progress, stage, result in frame[["seq", "status", "progress", "current_stage", "result_id"]].itertuples(index=False):
            if last is not None and (last[1] in ENDED or tuple(last[1:]) == (status, progress, stage)):
                continue
            last = (int(seq), status, int(progress), stage)
            out.append((key[0], *last, result if status == "completed" else None))
        if last is not None:
            self.last.update(tuple(last))
        yield pd.DataFrame(out, columns=["job_id", "seq", "status", "progress", "current_stage", "result_id"])

    def close(self) -> None:
        pass


def progress_feed(log: DataFrame, keep_hours: int = 48) -> DataFrame:
    """The streaming form of ``changes`` over a log of (job_id, seq, status, progress, current_stage, result_id): a state per job, dropped after so many hours without news.

    result_id is passed on with the state 'completed' alone.
    """
    return log.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_OnlyChanges(keep_hours), outputStructType=FEED, outputMode="Append", timeMode="ProcessingTime")


def batch_feed(log: DataFrame) -> DataFrame:
    """The same over a log at rest: changes of each job up to its first end, with result_id where it is completed."""
    told = changes(log, "job_id", ["seq"], list(STATE))
    ended = F.count_if(F.col("status").isin(*ENDED)).over(W.partitionBy("job_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    return told.withColumn("__ended", ended).filter("__ended = 0").drop("__ended").withColumn("result_id", F.when(F.col("status") == "completed", F.col("result_id")))


def merged_states(states: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest row of each job, of the table of states and a batch of news of the same columns."""
    from ..operators.library import latest

    return latest(states.unionByName(batch.select(*states.columns)), "job_id", "seq")


def live(rows: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    """Requests and tokens that haven't expired."""
    return rows.filter(F.col(expires) >= F.lit(now).cast("timestamp"))

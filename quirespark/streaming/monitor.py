"""Parents of jobs, kept up to date from a stream of news about their children, over restarts.

Each batch makes a version: the latest state of every child whose parent goes on, and what all parents are. A version is named by the batch's number and counts once its last file is there, so a batch that comes
again after a restart is left out if it was done, and done anew if it wasn't. The next version is made from written tables alone, so plans don't grow. A parent that has ended stays as it is: its children leave the
states, and later news of them is dropped.

Defined results: of several news of a child in a batch the one with the largest ``seq`` counts; news older than what is known too. Jobs without a parent are none of this.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.longdoc import parent_status
from ..stored import drop, exists, listed
from .feed import merged_states

NEWS = "job_id string, seq bigint, parent_job_id string, chapter_index int, status string, progress int"
PARENTS = "parent_job_id string, status string, progress int"
#: States in which a parent isn't watched any more.
OVER = ("completed", "failed")


@dataclass
class ParentMonitor:
    """A function for ``foreachBatch``. ``folder``: where versions are; ``keep``: how many of them."""

    folder: str
    keep: int = 2

    def versions(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches that are done, of those that are kept."""
        found = [int(n.partition("=")[2]) for n in listed(spark, self.folder) if n.startswith("version=")]
        return sorted(v for v in found if exists(spark, f"{self.folder}/version={v}/states/_SUCCESS"))

    def read(self, spark: SparkSession, version: int | None, what: str, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{self.folder}/version={version}/{what}")

    def parents(self, spark: SparkSession) -> DataFrame:
        """parent_job_id, status and progress of all parents by the last batch that is done."""
        return self.read(spark, max(self.versions(spark), default=None), "parents", PARENTS)

    def states(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, max(self.versions(spark), default=None), "states", NEWS)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, self.versions(batch.sparkSession)
        if done and number <= done[-1]:
            return
        last, path = max(done, default=None), f"{self.folder}/version={number}"
        before, parents = self.read(spark, last, "states", NEWS), self.read(spark, last, "parents", PARENTS)
        over = parents.filter(F.col("status").isin(*OVER)).select("parent_job_id")
        news = batch.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in NEWS.split(", ")]).filter("parent_job_id is not null").join(over, "parent_job_id", "left_anti")
        now = merged_states(before, news)
        touched = news.select("parent_job_id").distinct()
        rolled = parent_status(now.join(touched, "parent_job_id", "left_semi"))
        parents.join(rolled, "parent_job_id", "left_anti").unionByName(rolled).write.mode("overwrite").parquet(f"{path}/parents")
        ended = spark.read.schema(PARENTS).parquet(f"{path}/parents").filter(F.col("status").isin(*OVER))
        now.join(ended, "parent_job_id", "left_anti").select(*before.columns).write.mode("overwrite").parquet(f"{path}/states")
        for old in done[: max(0, len(done) + 1 - self.keep)]:
            drop(spark, f"{self.folder}/version={old}")

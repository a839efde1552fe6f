from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from quirespark.operators.longdoc import parent_status
from quirespark.streaming import expiry as E
from quirespark.streaming import monitor as N


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def news(rng, n, seq=0):
    return [(f"j{rng.randrange(40)}", seq + i, None, rng.randrange(9), rng.choice(["pending", "translating", "completed", "completed", "failed"][: 5 if rng.random() < 0.02 else 4]), rng.randrange(100)) for i in range(n)]


def of_parents(rows):
    return [(j, s, f"p{int(j[1:]) % 8}", c, status, p) for j, s, _, c, status, p in rows]


def plain(batches):
    """All parents after each batch, from whole tables in memory; those that are over stay."""
    latest, parents = {}, {}
    for rows in batches:
        touched = set()
        for r in sorted(rows, key=lambda r: r[1]):
            if r[2] is not None and parents.get(r[2], ("",))[0] not in N.OVER:
                touched.add(r[2])
                if latest.get(r[0], r)[1] <= r[1]:
                    latest[r[0]] = r
        for p in touched:
            own = sorted([r for r in latest.values() if r[2] == p], key=lambda r: r[3])
            status = [r[4] for r in own]
            done = status.count("completed")
            active = [(r[3], r[4], r[5]) for r in own if r[4] == "translating"]
            told = "failed" if "failed" in status else "completed" if done == len(own) else min(active)[1] if active else "pending"
            parents[p] = (told, 100 if done == len(own) else (done * 100 + (min(active)[2] if active else 0)) // len(own))
    return parents


def test_a_query_that_is_restarted_gives_the_same_parents(spark, tmp_path):
    rng = random.Random(3)
    batches = [of_parents(news(rng, 25, 1000 * i)) for i in range(6)] + [[("x", 1, None, 0, "completed", 1)]]
    monitor = lambda: N.ParentMonitor(str(tmp_path / "parents"))
    for i, rows in enumerate(batches):  # a file, and a query from its checkpoint, for each
        spark.createDataFrame(rows, N.NEWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(N.NEWS).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(monitor()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert {r.parent_job_id: (r.status, r.progress) for r in monitor().parents(spark).collect()} == plain(batches[: i + 1])
    assert len(monitor().versions(spark)) == 2


def test_plans_stay_short_and_batches_count_once(spark, tmp_path):
    rng = random.Random(5)
    batches, lengths = [of_parents(news(rng, 6, 100 * i)) for i in range(50)], set()
    for i, rows in enumerate(batches):
        monitor, df = N.ParentMonitor(str(tmp_path / "m")), spark.createDataFrame(rows, N.NEWS)
        monitor(df, i)
        if i % 10 == 3:  # the same batch again, and an old one
            monitor(df, i)
            monitor(df, i - 1)
        if i > 1:
            lengths.add(len(monitor.states(spark)._jdf.queryExecution().logical().toString().split("\n")))
    assert len(lengths) == 1 and {r.parent_job_id: (r.status, r.progress) for r in monitor.parents(spark).collect()} == plain(batches)


def test_half_a_version_is_made_anew(spark, tmp_path):
    monitor = N.ParentMonitor(str(tmp_path / "m"))
    rows = spark.createDataFrame(of_parents([("j1", 1, None, 0, "translating", 50)]), N.NEWS)
    rows.limit(0).select("parent_job_id", "status", "progress").write.parquet(str(tmp_path / "m" / "version=0" / "parents"))  # as if it had stopped here
    assert monitor.versions(spark) == []
    monitor(rows, 0)
    assert [(r.parent_job_id, r.progress) for r in monitor.parents(spark).collect()] == [(r.parent_job_id, r.progress) for r in parent_status(rows).collect()] == [("p1", 50)]


def told(rows):
    return sorted((r.key, r.kind, r.event) for r in rows)


def test_timers_tell_what_nobody_has_closed(rocks, tmp_path):
    spark, terms = rocks, {"request": 1.0, "operation": 600.0}
    put = lambda rows: spark.createDataFrame(rows, E.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "request", 1, False), ("b", "operation", 1, False), ("c", "request", 1, False), ("c", "request", 2, True), ("d", "request", 1, True)])
    q = E.expiring(spark.readStream.schema(E.EVENTS).parquet(str(tmp_path / "in")), terms).writeStream.format("memory").queryName("terms").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        want = [("a", "request", "expired"), ("a", "request", "opened"), ("b", "operation", "opened"), ("c", "request", "closed"), ("c", "request", "opened")]
        end = time.time() + 90
        while told(spark.table("terms").collect()) != want and time.time() < end:
            time.sleep(0.5)
        assert told(spark.table("terms").collect()) == want
        put([("a", "request", 9, True), ("b", "operation", 9, True)])  # the first has expired, the second hasn't
        want = sorted([*want, ("b", "operation", "closed")])
        while told(spark.table("terms").collect()) != want and time.time() < end:
            time.sleep(0.5)
        assert told(spark.table("terms").collect()) == want
    finally:
        q.stop()


def test_expiry_at_rest(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(6)}", rng.choice(["request", "operation", "odd"]), rng.randrange(20_000_000), rng.random() < 0.4) for _ in range(200)]
    now = 21_000_000
    want = []
    for k in {r[0] for r in rows}:
        held = None
        for _, kind, at, closes in sorted([r for r in rows if r[0] == k], key=lambda r: (r[2], r[3])):
            if held and held[1] < at:
                want.append((k, held[0], "expired", held[1]))
                held = None
            if not closes:
                held = (kind, at + 1000 * E.TERMS.get(kind, 900))
                want.append((k, kind, "opened", at))
            elif held:
                want.append((k, held[0], "closed", at))
                held = None
        if held and held[1] < now:
            want.append((k, held[0], "expired", held[1]))
    got = E.at_rest(spark.createDataFrame(rows, E.EVENTS), now).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert E.at_rest(spark.createDataFrame([], E.EVENTS).withColumn("x", F.lit(1)), now).count() == 0

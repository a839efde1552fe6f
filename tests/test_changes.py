from quirespark import models
from quirespark.operators import closure
from quirespark.operators import library as L


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deleting_jobs_gathers_no_ids(spark):
    jobs = spark.createDataFrame([("a", None, "P"), ("b", "a", "F"), ("b", "a", "F"), ("c", None, "F"), ("d", "c", "P"), (None, None, "F")], "id string, parent_job_id string, status string")
    after, results = L.delete_by_status(jobs, jobs.select(jobs.id.alias("job_id")), ["P"])
    assert "Aggregate" not in plan(after) + plan(results)
    assert {r.id for r in after.collect()} == {"c", "d", None} and {r.job_id for r in results.collect()} == {"c", "d", None}


def test_a_job_that_starts_as_child_and_as_parent_is_one_row(spark):
    jobs = spark.createDataFrame([("p", None, "failed", 5), ("c", "p", "failed", 5), ("g", "c", "failed", 5), ("x", None, "completed", 100)], "id string, parent_job_id string, status string, progress int")
    ids = spark.createDataFrame([("p",), ("c",)], "id string")
    after, results = L.restart_failed(jobs, jobs.select(jobs.id.alias("job_id")), ids)
    assert {r.id: (r.status, r.progress) for r in after.collect()} == {"p": ("pending", 0), "c": ("pending", 0), "g": ("pending", 0), "x": ("completed", 100)}
    assert after.count() == 4 and {r.job_id for r in results.collect()} == {"x"}


def test_links_of_trees_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9)], "id long, parent_id long")
    assert "Broadcast" not in plan(closure.linked(rows, "id", "parent_id"))
    assert {(r.id, r.depth) for r in L.subtree(rows, 1).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_texts_stay_out_of_tasks_that_need_none(spark):
    rows = spark.createDataFrame([(1, "# a\nlong text")], "d long, text string")
    made = models._stage(rows, ["d"], ["text"], "n", models.Stub(), "headings", lambda t, a: f"{len(t)} {a}", of_text=False)
    assert [tuple(r) for r in made.collect()] == [(1, "0 []")]

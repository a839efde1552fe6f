from __future__ import annotations

import os

import pyarrow as pa
import pytest

from quirespark.llm import common


def test_written_tables_outlive_their_source_until_cleared(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    table = common.written(spark.read.parquet(str(tmp_path / "in")), "copy")
    for f in os.listdir(tmp_path / "in"):
        os.remove(tmp_path / "in" / f)
    assert table.count() == 3
    folder = common.shared_dir(spark).rpartition("/")[0].removeprefix("file://")
    assert os.listdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)


def test_what_passes_is_deleted_and_the_result_stays(spark):
    with common.passing(spark):
        first = common.written(spark.range(3), "first")
        last = common.written(first.withColumn("x", first.id + 1), "last")
    path = lambda df: df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert last.count() == 3 and os.path.exists(path(last)) and not os.path.exists(path(first))


def test_a_cluster_needs_the_setting(spark):
    class Away:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Away)


def test_shield_gives_names_back(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, text int, __col0 int")
    inner, back = common.shielded(df, ("text",))
    assert inner.columns == ["__col0", "text", "__col2"] and back(inner).columns == df.columns and tuple(back(inner).first()) == (1, 2, 3)


def test_a_worker_holds_one_table_of_words():
    let_go = []
    common._held.clear()
    for name in ("a", "a", "b", "", "a"):
        common.holds(name, lambda name=name: let_go.append(name)) if name else common.holds()
    assert let_go == ["a", "b"]
    common._held.clear()


@pytest.mark.parametrize("kind", [(pa.string(), pa.binary()), (pa.large_string(), pa.large_binary())])
def test_strings_of_broken_bytes(kind):
    given = pa.array([b"a\xc3 b", None, "\u00e9".encode(), b""], kind[1]).view(kind[0])
    assert common.strings(given) == ["a\ufffd b", None, "\u00e9", ""]
    assert common.strings(given[1:]) == [None, "\u00e9", ""]

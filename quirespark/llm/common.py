"""Helpers that several training-data operators share: places for written tables and files, and text access in Arrow batches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the Arrow batches in which rows go to Python, after ``light_batches``.
BATCH = 4 << 20
#: Characters that separate words: space, and U+0009 to U+000D. bytes.split() cuts at exactly these.
WORD_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is empty and driver and executors are one process (tests, a notebook), a temporary folder of this machine is set for the session; on a cluster the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark.sparkContext, "_quire_dir", None)
        if not base:
            base = "file://" + (own := tempfile.mkdtemp(prefix="quire-"))
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext._quire_dir = base
    return f"{base.rstrip('/')}/quire/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes everything that this application's operators have written to the shared folder; their results can't be read afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark).rpartition("/")[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}"
    for paths in _passing:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, column: str) -> DataFrame:
    """As ``written``, dealt to buckets by a column as Spark's shuffles deal, so that what groups by that column later reads it without a shuffle, as often as it likes. Rows stay in the files of the tasks that have them."""
    spark, name = df.sparkSession, f"quire_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{what}"
    for paths in _passing:
        paths.append(path)
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(name)
    table = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files aren't the catalog's
    return table


#: Paths that ``written`` has made inside each open ``passing``.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` has made inside it, but for the last one: that is its result."""
    _passing.append(paths := [])
    try:
        yield
    finally:
        _passing.remove(paths)
        for p in paths[:-1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(p.rpartition("/")[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a folder's URI, and the folder's path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type):
        return col.cast(pa.large_binary()).to_pylist()
    return col.cast(pa.binary()).to_pylist()


def strings(column: pa.Array) -> list[str | None]:
    """A string column's values; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [t if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def light_batches(spark: SparkSession) -> None:
    """From now on rows of this session go to Python in batches of about BATCH bytes, unless it has a limit of its own. By Spark's default they are of 10,000 rows or 64 MB,
    and a task holds several copies of one outside the heap, in buffers that double as they grow: whole texts then take hundreds of MB of an executor."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH))


def pieces(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices, so that what Python holds of it at once stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives every slice of every batch to ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, rows):
                yield make(part)

    return run


_held: list[tuple[str, Callable[[], object]]] = []


def holds(name: str = "", let_go: Callable[[], object] = lambda: None) -> None:
    """Says which table of words (or none) this worker holds from now on. What another operator has left in it is let go, so that a worker that serves one stage after another holds one such table at a time."""
    if _held and _held[0][0] != name:
        _held.pop()[1]()
        gc.collect()
    if name and not _held:
        _held.append((name, let_go))


def text_key() -> F.Column:
    """Stands for the whole text of a row, beside its doc_id, where rows are told apart. A null text has a key of its own."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns: what else a table holds can't clash with columns that operators add."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def shielded(df: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all but the needed columns under names that clash with nothing, and a function that gives a result the old ones back."""
    names = [c if c in needed else f"__col{i}" for i, c in enumerate(df.columns)]
    old = df.columns
    return df.toDF(*names), lambda out: out.select(*[F.col(n).alias(c) for n, c in zip(names, old)])

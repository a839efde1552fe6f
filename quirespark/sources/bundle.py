"""Bundles of changed rows: a sink that is either whole or not there.

Tasks write their rows as Parquet files under names of their own. The commit writes the table's manifest, of the files of successful attempts alone; an abort deletes what was written. The bundle's own manifest comes
last, so a bundle with a table that failed doesn't exist. Readers see what manifests name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..stored import stored
from .large import opened

MANIFEST = "manifest.json"


def put(fs: pafs.FileSystem, draft: str, name: str) -> None:
    """Gives a whole draft its name, in the place of a file that has it."""
    if fs.get_file_info(name).is_file and fs.type_name != "local":
        fs.delete_file(name)  # stores other than a local one don't move onto a file
    fs.move(draft, name)


def written_at_once(folder: str, name: str, what: dict) -> None:
    """A small JSON file that is there whole or not at all."""
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(json.dumps(what, sort_keys=True).encode())
    put(fs, draft, f"{path}/{name}")


def told(folder: str, name: str = MANIFEST) -> dict | None:
    fs, path = opened(folder)
    if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{path}/{name}") as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, path = opened(self.folder)
        fs.create_dir(path, recursive=True)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{path}/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out:
                out.close()
                fs.delete_file(f"{path}/{name}")
            raise
        if out:
            out.close()
        return Part(name if out else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m.name, m.rows) for m in messages if m and m.name)
        written_at_once(self.folder, MANIFEST, {"parts": [p for p, _ in parts], "rows": sum(n for _, n in parts)})

    def abort(self, messages: list[Part | None]) -> None:
        """Tasks that are still stopping may leave files after this; no manifest names them."""
        fs, path = opened(self.folder)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class Bundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_bundle"

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


def write_bundle(tables: dict[str, DataFrame], folder: str) -> dict:
    """Writes the changed rows of each table below a folder; returns the bundle's manifest. A folder that already is a bundle is an error."""
    if told(folder, "bundle.json"):
        raise FileExistsError(f"{folder} is a bundle")
    counts = {}
    for name, rows in tables.items():
        spark = rows.sparkSession
        spark.dataSource.register(Bundle)
        rows.write.format("quire_bundle").mode("append").save(f"{folder}/{name}")
        counts[name] = {"rows": told(f"{folder}/{name}")["rows"], "schema": rows.schema.jsonValue()}
    written_at_once(folder, "bundle.json", {"tables": counts})
    return {"tables": counts}


def read_bundle(spark: SparkSession, folder: str, name: str) -> DataFrame:
    whole = told(folder, "bundle.json")
    if whole is None:
        raise FileNotFoundError(f"{folder} is no bundle")
    kind, parts = StructType.fromJson(whole["tables"][name]["schema"]), told(f"{folder}/{name}")["parts"]
    return spark.read.schema(kind).parquet(*[f"{folder}/{name}/{p}" for p in parts]) if parts else spark.createDataFrame([], kind)


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """The rows with gapless numbers from 0 in an order: sorted by ranges, numbered in each part, and moved by how many rows the parts before have."""
    parts = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    begins = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", before.alias("__begin"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__inside", inside).join(begins, "__part").withColumn(name, F.col("__begin") + F.col("__inside")).drop("__part", "__inside", "__begin")

from __future__ import annotations

import hashlib
import os
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from quirespark.sources import bundle, large
from quirespark.sources import files as X


def archive(path, members: dict[str, bytes]) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_members_in_pieces(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    one, two = {"t.md": b"x" * 2500, "e.md": b"", "i.png": bytes(range(256)) * 20}, {"d/t.md": "ü".encode() * 700, "d/": b""}
    archive(tmp_path / "a" / "one.zip", one)
    archive(tmp_path / "a" / "b" / "two.zip", two)
    (tmp_path / "a" / "no.txt").write_bytes(b"no archive")
    got: dict = {}
    for r in large.archive_pieces(spark, str(tmp_path / "a"), piece=1000).orderBy("path", "name", "piece").collect():
        got.setdefault((os.path.basename(r.path), r.name), []).append(bytes(r.content))
    assert {k: b"".join(v) for k, v in got.items()} == {("one.zip", k): v for k, v in one.items()} | {("two.zip", "d/t.md"): two["d/t.md"]}
    assert len(got["one.zip", "t.md"]) == 3 and got["one.zip", "e.md"] == [b""]
    assert {(r.name, r.text) for r in large.archive_texts(spark, str(tmp_path / "a"), "*.md").collect()} == {("t.md", "x" * 2500), ("e.md", ""), ("d/t.md", "ü" * 700)}
    assert large.archive_pieces(spark, str(tmp_path / "none")).count() == 0


def test_members_are_dealt_to_tasks(tmp_path):
    archive(tmp_path / "m.zip", {f"{i}": b"x" * 100 for i in range(10)})
    parts = large.ArchiveReader({"path": str(tmp_path), "task": "250"}).partitions()
    assert [len(p.names) for p in parts] == [2, 2, 2, 2, 2]


def test_files_of_over_two_gigabytes(spark, tmp_path):
    """A sparse file, and an archive with a member as long, which is deflated to little: read in pieces, never whole."""
    size = (2 << 30) + 12_345
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
    digest, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(block)
    digest.update(bytes(size & ((1 << 20) - 1)))
    r = X.inventory(spark, str(tmp_path), "*.bin").first()
    assert (r["size"], r.sha256, r.is_file) == (size, digest.hexdigest(), True)
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("zeros", "w", force_zip64=True) as f:
        for _ in range(size >> 20):
            f.write(block)
        f.write(bytes(size & ((1 << 20) - 1)))
    reader = large.ArchiveReader({"path": str(tmp_path), "piece": str(8 << 20)})
    before, total = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    for part in reader.partitions():
        for *_, piece in reader.read(part):
            total += len(piece)
    assert total == size and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_inventory(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "d" / "b.txt").write_bytes(b"")
    got = {(os.path.basename(r.path), r["size"], r.sha256) for r in X.inventory(spark, str(tmp_path), "*.txt").collect()}
    assert got == {("a.txt", 3, hashlib.sha256(b"one").hexdigest()), ("b.txt", 0, hashlib.sha256(b"").hexdigest())}


def test_bundles_are_whole_or_not_there(spark, tmp_path):
    rows, bad = spark.range(1000).repartition(7), spark.range(100).repartition(5).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="broken"):
        bundle.write_bundle({"good": rows, "bad": bad}, str(tmp_path / "b"))
    with pytest.raises(FileNotFoundError):
        bundle.read_bundle(spark, str(tmp_path / "b"), "good")
    assert not os.path.exists(tmp_path / "b" / "bad" / "manifest.json") and not os.path.exists(tmp_path / "b" / "bundle.json")
    made = bundle.write_bundle({"good": rows, "none": rows.limit(0), "kinds": spark.sql("select 1 as a, array(struct('x' as s)) as b, date'2020-01-01' as c")}, str(tmp_path / "c"))
    assert made["tables"]["good"]["rows"] == 1000
    (tmp_path / "c" / "good" / "part-stray.parquet").write_bytes(b"of an attempt that failed")
    assert sorted(r.id for r in bundle.read_bundle(spark, str(tmp_path / "c"), "good").collect()) == list(range(1000))
    assert bundle.read_bundle(spark, str(tmp_path / "c"), "none").count() == 0 and bundle.read_bundle(spark, str(tmp_path / "c"), "kinds").first().b[0].s == "x"
    with pytest.raises(FileExistsError):
        bundle.write_bundle({"good": rows}, str(tmp_path / "c"))


def test_numbers_without_gaps(spark):
    rows = spark.range(500).selectExpr("id", "concat('p', lpad(cast(id * 7 % 500 as string), 3, '0')) as path").repartition(6)
    got = bundle.numbered(rows, "path").orderBy("path").collect()
    assert [r.number for r in got] == list(range(500)) and bundle.numbered(rows.limit(0), "path").count() == 0


def test_the_current_version_is_a_whole_one(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        X.current_table(spark, path)
    for v in (1, 2):
        X.replace_table(spark.range(v * 10), path, v)
    os.makedirs(f"{path}/version=3")  # begun and never ended
    rows, version = X.current_table(spark, path)
    assert (rows.count(), version) == (20, 2)
    with pytest.raises(FileNotFoundError):
        X.roll_back(path, 3)
    X.roll_back(path, 1)
    assert X.current_table(spark, path)[1] == 1 and X.current_table(spark, path)[0].count() == 10

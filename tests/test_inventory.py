"""Inventories: filters that reach the listing, trees of any shape dealt to tasks, and a stream of changes."""

import os
import time

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from gleaner.functions.text import split_extension
from gleaner.sources import inventory
from gleaner.sources.inventory import Rules, frontier, scan


def put(root, *names, size=1):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * size)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_listing(spark, tmp_path):
    put(tmp_path, "a/1.jpg", "a/2.txt", "b/3.JPG", "bc/4.jpg", "b/deep/5.mp4")
    put(tmp_path, "a/big.jpg", size=500)
    files, root = inventory.table(spark, [str(tmp_path)]), str(tmp_path)
    names = lambda df: sorted(os.path.relpath(r.path, root) for r in df.collect())
    some = files.where(F.startswith("path", F.lit(f"{root}/b/")) & F.col("extension").isin(".jpg", ".mp4") & (F.col("size") < 100))
    assert names(some) == ["b/3.JPG", "b/deep/5.mp4"]
    assert ") Filter" not in plan(some) and "StringStartsWith(path" in plan(some) and "LessThan(size" in plan(some)
    assert names(files.where(~F.startswith("path", F.lit(f"{root}/b")))) == ["a/1.jpg", "a/2.txt", "a/big.jpg"]
    assert names(files.where("size >= 2 and size <= 500")) == names(files.where("size = 500")) == names(files.where("size > 499")) == ["a/big.jpg"]
    assert names(files.where("size > 1000 or extension = '.txt'")) == ["a/2.txt"]  # not one that the source knows
    assert names(files.where("mtime_ns > 0 and extension = '.mp4'")) == ["b/deep/5.mp4"]


def test_trees_that_are_ruled_out_are_never_opened(spark, tmp_path, monkeypatch):
    put(tmp_path, "in/a/1.jpg", "in/dups/x/2.jpg", "in/dups2/3.jpg", "out/4.jpg")
    opened, one = [], inventory._opened
    monkeypatch.setattr(inventory, "_opened", lambda path: opened.append(os.path.relpath(path, tmp_path)) or one(path))
    reader = inventory.InventoryReader({"roots": str(tmp_path)})
    left = list(reader.pushFilters([ds.StringStartsWith(("path",), f"{tmp_path}/in/"), ds.Not(ds.StringStartsWith(("path",), f"{tmp_path}/in/dups/")), ds.IsNotNull(("path",)), ds.GreaterThan(("mtime_ns",), 5), ds.Not(ds.EqualTo(("size",), 1))]))
    assert [type(f) for f in left] == [ds.GreaterThan, ds.Not]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert sorted(os.path.basename(r[0]) for r in rows) == ["1.jpg", "3.jpg"]
    assert set(opened) == {".", "in", "in/a", "in/dups2"}
    assert sorted(os.path.basename(r.path) for r in scan(spark, [str(tmp_path)], exclude=f"{tmp_path}/in/dups").collect()) == ["1.jpg", "3.jpg", "4.jpg"]


def test_a_chain_and_a_wide_folder_are_many_tasks_work(spark, tmp_path):
    put(tmp_path, *[f"wide/{i}.txt" for i in range(3000)])
    here = os.open(tmp_path, os.O_RDONLY)
    os.mkdir("deep", dir_fd=here)
    for i in range(3000):  # paths of more than 4,096 characters
        name = "deep" if i == 0 else "d"
        if i:
            os.mkdir(name, dir_fd=here)
        following = os.open(name, os.O_RDONLY, dir_fd=here)
        os.close(here)
        here = following
        if i % 100 == 0:
            os.close(os.open("f.txt", os.O_WRONLY | os.O_CREAT, dir_fd=here))
    os.close(here)
    rows = frontier(spark, [str(tmp_path)], Rules(), most=400).withColumn("task", F.spark_partition_id())
    assert rows.count() == 3030 and rows.where("path like '%/deep/%'").count() == 30 and rows.agg(F.max(F.length("path"))).first()[0] > 5000
    wide = rows.where("path like '%/wide/%'")
    assert wide.groupBy("task").count().agg(F.max("count")).first()[0] <= 3000 // 2
    assert scan(spark, [str(tmp_path), str(tmp_path / "wide"), "/no/such/root"]).count() == 3030


def test_rows_of_a_scan(spark, tmp_path):
    names = ["a.JPG", ".hidden", "..mp4", "x.", "no", "two.tar.gz", "ü .Txt", "empty"]
    put(tmp_path, *names)
    (tmp_path / "empty").write_bytes(b"")
    os.symlink(tmp_path / "no", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "loop")
    os.mkfifo(tmp_path / "pipe")
    rows = scan(spark, [str(tmp_path)]).withColumn("want", split_extension(F.col("path"))).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == sorted(names) and all(r.extension == r.want for r in rows)
    for r in rows:
        s = os.stat(r.path)
        assert (r.size, r.mtime_ns, r.dev, r.ino) == (s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino)
    assert len(scan(spark, [str(tmp_path)], follow_file_symlinks=True).collect()) == len(names) + 1
    assert scan(spark, []).count() == scan(spark, [str(tmp_path / "no")]).count() == 0
    by_source = {tuple(r) for r in inventory.table(spark, [str(tmp_path)]).collect()}
    assert by_source == {tuple(r)[:6] for r in rows}


def test_changes_come_once(spark, tmp_path):
    put(tmp_path / "in", "a", "sub/b")

    def run():
        stream = inventory.changes(spark, [str(tmp_path / "in")], settle=0).select("path", "size", "ctime_ns")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((os.path.basename(r.path), r.size) for r in spark.read.schema("path string, size long, ctime_ns long").parquet(str(tmp_path / "out")).collect())

    assert run() == [("a", 1), ("b", 1)]
    put(tmp_path / "in", "c")
    os.utime(tmp_path / "in/c", (5, 5))  # an old time of its own
    put(tmp_path / "in", "a", size=7)
    time.sleep(0.01)
    assert run() == [("a", 1), ("a", 7), ("b", 1), ("c", 1)]
    assert run() == [("a", 1), ("a", 7), ("b", 1), ("c", 1)]
    young = inventory.ChangesReader({"roots": str(tmp_path / "in"), "settle": "3600"})
    assert [r for p in young.partitions({"until": 0}, young.latestOffset()) for r in young.read(p)] == []


@pytest.mark.parametrize("bad", ["", "/no/such/root"])
def test_no_roots(spark, bad):
    reader = inventory.InventoryReader({"roots": bad})
    assert [r for p in reader.partitions() for r in reader.read(p)] == []

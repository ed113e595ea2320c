"""Reports by the executors: the same bytes as the driver's, and nothing left of a failed write."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.operators.moves import write_report
from gleaner.sources import reports


@pytest.mark.parametrize("n", [0, 1, 57])
def test_a_list_is_what_the_driver_would_write(spark, tmp_path, n):
    rows = [{"source": f"/é{i}", "destination": None if i % 5 == 0 else f'/d"{i}', "status": "moved", "processed": i} for i in range(n)]
    df = spark.createDataFrame([(r["source"], r["destination"], r["status"], r["processed"]) for r in rows], "source string, destination string, status string, processed long")
    reports.write(df.repartition(5).orderBy("processed"), f"{tmp_path}/deep/r.json")
    write_report(rows, f"{tmp_path}/want.json")
    assert (tmp_path / "deep/r.json").read_text() == (tmp_path / "want.json").read_text()
    assert os.listdir(tmp_path / "deep") == ["r.json"]


def test_lines_replace_what_was_there(spark, tmp_path):
    for n in (3, 20):
        df = spark.range(n).select("id", F.lit(dt.date(2020, 1, 2)).alias("day"), F.lit(bytearray(b"\x01")).alias("raw")).repartition(4)
        reports.write(df, f"{tmp_path}/lines", "lines")
        found = [json.loads(x) for name in os.listdir(tmp_path / "lines") if name.endswith(".json") for x in (tmp_path / "lines" / name).read_text().splitlines()]
        assert sorted(r["id"] for r in found) == list(range(n)) and found[0]["day"] == "2020-01-02" and found[0]["raw"] == "01"
        assert (tmp_path / "lines/_SUCCESS").exists() and os.listdir(tmp_path) == ["lines"]


@pytest.mark.parametrize("layout", ["list", "lines"])
def test_a_failed_task_leaves_nothing_and_the_old_report_stays(spark, tmp_path, layout):
    reports.write(spark.range(2), f"{tmp_path}/r", layout)
    before = sorted(os.listdir(tmp_path / "r")) if layout == "lines" else (tmp_path / "r").read_text()
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 35, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        reports.write(bad, f"{tmp_path}/r", layout)
    assert os.listdir(tmp_path) == ["r"]
    assert before == (sorted(os.listdir(tmp_path / "r")) if layout == "lines" else (tmp_path / "r").read_text())
    with pytest.raises(ValueError):
        reports.write(bad, f"{tmp_path}/x", "table")

"""The candidate queries take whole contents of files of any size."""

import pytest

from gleaner.plans import catalogue

TEXTS = ["short", "short", "a" * 300, "a" * 300, "b" * 256 + "one tail", "b" * 256 + "two tail", "c" * 400, ""]


@pytest.mark.parametrize("name", ["quick_candidates", "full_candidates"])
def test_candidates_of_whole_contents(spark, tmp_path, name):
    rows = [(i, t, "en", "web") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.path.split("/")[-1].split(".")[0]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {0, 1, 2, 3}

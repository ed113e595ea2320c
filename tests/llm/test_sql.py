"""The operators that SQL can express give the rows of their SQL."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from gleaner.llm import queries

from .test_llm import DATA


def same(spark, name, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    got = queries.QUERIES[name](spark, str(folder))
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want, rows = ([tuple(map(str, r)) for r in x] for x in (cursor.fetchall(), got.select(*names).collect()))
    assert sorted(want) == sorted(rows)
    return rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_given_tables(spark, name):
    assert same(spark, name, DATA)


def test_links_of_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base[:4]])
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert any(r[1] != "0" for r in same(spark, "op5_embeddings", tmp_path))


def test_licences_and_spellings(spark, tmp_path):
    rows = [(1, "Released under the MIT Licence."), (2, "x\nLicensed under CC BY-NC 4.0!\r\n© somebody"), (3, None), (4, "SPDX-License-Identifier:  mit\n(c) 2020 x"), (None, "Licensed under the MIT License")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(same(spark, "op7_licenses", tmp_path)) == 7


def test_aliases_and_odd_pages(spark, tmp_path):
    page = lambda k, u, h="": (k, u, h)
    rows = [page(1, "http://a.example/x", '<link rel="canonical" href="http://b.net/en">'), page(2, "HTTP://B.net/en"), page(2, "HTTP://B.net/en"), page(3, None, None), page(4, "no scheme"), page(5, "http://x.example.net/en/?q#f"),
            page(6, "http://c.example/1", '<meta http-equiv="refresh" content="0; url=/2">'), page(7, "http://c.example/2", "<link href='http://d.org/fr/' rel=canonical>"), page(None, "http://www.example.com/de/x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r[:1] + r[-1:] for r in same(spark, "op9_urls", tmp_path)}
    assert len(got) >= 7
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert same(spark, "op9_urls", tmp_path / "none") == []

"""Every query of the catalogue gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pytest

from gleaner.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(columns, values):
    return sorted(tuple("-" if v is None else round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert rows(columns, map(tuple, got.select(*columns).collect())) == rows(columns, want)


@pytest.mark.parametrize("name, table", [("image_pairs", "frames"), ("video_pairs", "clips")])
def test_pairs_tell_all_pairs_of_rows(spark, name, table):
    """Links and members give back every pair of similar rows in a block, copies and other rows with equal marks included, and ``pairs`` their number."""
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    near, more = ("bit_count(xor(a.h, b.h))", "true") if table == "frames" else (" + ".join(catalogue.EACH), f"greatest({', '.join(catalogue.EACH)}) <= 12")
    block = f"width // 64, height // 64, {catalogue.PREFIX('h')}" if table == "frames" else f"floor(duration / 2), round_even(width / height * 10, 0), {catalogue.PREFIX('f0')}"
    most = 8 if table == "frames" else 32
    views = catalogue.IMAGES if table == "frames" else catalogue.CLIPS
    want = con.execute(f"with {views}, keyed as (select *, ({block}) as block from {table}) select a.path, b.path, ({near})::int from keyed a join keyed b on a.block = b.block and a.path < b.path where {near} <= {most} and {more}").fetchall()
    got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    held = {}
    for r in got:
        if r.score == 0:
            held.setdefault(r.left, []).append(r.right)
    told = {(min(x, y), max(x, y), 0) for of in held.values() for x in of for y in of if x != y}
    told |= {(min(x, y), max(x, y), r.score) for r in got if r.score for x in held.get(r.left, [r.left]) for y in held.get(r.right, [r.right])}
    assert want and told == set(want) and sum(r.pairs for r in got) == len(want)

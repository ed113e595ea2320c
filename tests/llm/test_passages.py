"""Passages that repeat inside longer lines or across line ends."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import paragraphs, passages, queries, words
from gleaner.llm.common import written

DATA = "/root/testdata/sf0.001"
FOLDED = bytes(passages.FOLD)


def words_of(text):
    return text.encode().translate(FOLDED).split()


def test_passage_inside_different_lines(spark, tmp_path):
    w = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    shared = w("p", 60)
    wrapped = "\n".join(" ".join(f"p{i}" for i in range(k, k + 10)) for k in range(0, 60, 10))
    rows = [(1, f"é intro\n{w('a', 10)} {shared} {w('b', 7)}"), (2, f"{w('c', 50)} {shared} {w('d', 40)}"), (3, f"{w('e', 5)}\n{wrapped}\n{w('f', 9)}"), (4, w("p", 40)), (5, w("g", 200)), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_substrings(spark, str(tmp_path)).collect()}
    texts = dict(rows)
    assert set(got) == {1, 2, 3}
    for k, r in got.items():
        assert texts[k][r.start : r.start + r.length] == (wrapped if k == 3 else shared)
        assert (r.cluster_doc, r.cluster_para, r.kept, r.para) == (1, 1, k == 1, 0 if k == 2 else 1)


@pytest.mark.parametrize("often", [20_000, 0])
def test_every_shared_window_is_found(spark, often):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    at = defaultdict(set)
    for k, t in texts.items():
        w = words_of(t)
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].add((k, i))
    want = {p for v in at.values() if len({k for k, _ in v}) > 1 for p in v}
    got = set()
    for r in passages.repeated_passages(docs, often=often).collect():
        t = texts[r.doc_id]
        low, n = len(words_of(t[: r.start])), len(words_of(t[r.start : r.start + r.length]))
        got |= {(r.doc_id, i) for i in range(low, low + n - 49)}
    assert want and got == want


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated_texts(none).count() == 0


def test_words_and_lines_of_a_batch(spark):
    texts = ["Ein Wört, zwei", None, "", "a\n\nB-c 12345678x 12345678y\n", "\n", "last"]
    whole = pa.array(["cut off", *texts], pa.string())
    for most in (1 << 20, 1):
        got, lines, hashes = [], [], {}
        for low, high, c in words.chunks(whole.slice(1), most):
            raw = c.raw.tobytes()
            for i in range(high - low):
                some = [raw[a:b] for a, b in zip(c.start[c.bounds[i] : c.bounds[i + 1]], c.end[c.bounds[i] : c.bounds[i + 1]])]
                got.append(some)
                hashes.update({w.lower(): h for w, h in zip(some, c.hash[c.bounds[i] : c.bounds[i + 1]].tolist())})
            lines += [raw[a:b] for a, b in zip(*c.lines)]
        assert got == [(t or "").encode().replace(b",", b"").replace(b"-", b" ").split() for t in texts]
        assert lines == [x.encode() for t in texts for x in (t or "").split("\n") if x] and len(set(hashes.values())) == len(hashes) == 9


def test_bands_of_many_paragraphs_at_once():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 30, 7)]
    a, b = paragraphs.permutations(40)
    together = paragraphs.all_bands(np.concatenate(sets), np.array([0, 1, 31]), a, b, 4)
    alone = [paragraphs.all_bands(s, np.array([0]), a, b, 4)[0] for s in sets]
    assert (together == np.array(alone)).all() and len(set(together.ravel().tolist())) == 30


@pytest.mark.parametrize("few", [200_000, 0])
def test_common_passage_makes_a_row_for_each_copy(spark, few):
    rows, ends = [], {}
    for k in range(40):
        before, after = (" ".join(f"{c}{k}x{i}" for i in range(k)) for c in "ab")
        shared = " ".join(f"p{i}" for i in range(200)) if k else " ".join(f"p{i}" for i in range(100, 200))
        rows += [(k, f"{before}\n{shared} {after}")] * (2 if k == 7 else 1)
        ends[k] = len(before) + 1, len(shared)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {(r.doc_id, r.start, r.length, r.cluster_doc, r.kept) for r in passages.repeated_passages(docs, often=0, few=few).collect()}
    half = len(" ".join(f"p{i}" for i in range(149))), len(" ".join(f"p{i}" for i in range(100)))
    want = {(0, *ends[0], 0, True)}
    for k in range(1, 40):  # 151 windows each: the first 100 are in document 1 first, the last 51 in document 0
        want |= {(k, ends[k][0], half[0], 1, k == 1), (k, ends[k][0] + half[1] + 1, ends[0][1], 0, False)}
    assert got == want
    every = written(passages._candidates(docs, 50, spark.sparkContext.broadcast((np.full(1 << 17, 255, np.uint8), np.zeros(0, np.uint64))), True), "windows")
    held = passages._common(every, few)
    assert held.agg({"n": "sum"}).first()[0] == 51 + 40 * 151
    assert held.count() == (51 + 40 * 151 if few == 0 else 1 + 40 * 2)


@pytest.mark.parametrize(("often", "few"), [(0, 200_000), (0, 0), (20_000, 200_000)])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_text_that_repeats_itself_makes_a_row_for_each_copy(spark, monkeypatch, often, few, batch):
    rows, want = [], set()
    for k in range(40):  # a pair of words 30 times or more: two windows of 50 words, again and again
        before, pairs, after = " ".join(f"b{k}x{i}" for i in range(3 + k)), "p q " * (29 + k) + "p q", " ".join(f"a{k}x{i}" for i in range(k))
        rows += [(k, f"{before}\n{pairs}\n{after}")] * (3 if k == 7 else 1)
        if k:
            want.add((k, 1, len(before) + 1, len(pairs), 0, 1, False))
        else:  # of document 0 the first two windows are kept, the others repeat them
            want |= {(0, 1, len(before) + 1, 2 * 51 - 1, 0, 1, True), (0, 1, len(before) + 5, len(pairs) - 4, 0, 1, False)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    held, common = [], passages._common
    monkeypatch.setattr(passages, "_common", lambda rows, few: held.append(common(rows, few)) or held[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in passages.repeated_passages(docs, often=often, few=few).collect()]
        made = held[0].count() if held else 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want
    if few and held and batch > 7:
        assert made == 40 + 1 + 2


def test_passages_do_not_depend_on_where_runs_are_cut():
    rng = np.random.default_rng(5)
    for _ in range(200):
        where = np.cumsum(rng.choice([1, 1, 1, -1, -2, 4, 30], 40)) + 100  # first occurrences of successive windows
        cut = lambda share: np.unique(np.concatenate([[0], np.flatnonzero(rng.random(40) < share)]))

        def gathered(starts, at, stop, low, high):
            near = np.arange(len(starts)) > 0
            begin = np.flatnonzero(passages._begins(near, at, stop, low, high))
            return at[begin], np.maximum.reduceat(stop, begin), low[begin], np.maximum.reduceat(high, begin)

        each = np.arange(40)
        whole = gathered(each, each, each + 1, where, where)
        pieces = []
        for part in np.split(each, cut(0.2)[1:]):
            pieces.append(gathered(part, part, part + 1, where[part], where[part]))
        joined = [np.concatenate(x) for x in zip(*pieces)]
        assert all((a == b).all() for a, b in zip(whole, gathered(joined[0], *joined)))


def test_windows_are_shuffled_as_runs(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(2)
    counts, firsts = spark.sparkContext.accumulator(0), passages._firsts
    shared = spark.sparkContext.accumulator(0)

    def counted(batches):
        def read():
            for b in batches:
                counts.add(b.num_rows)
                yield b

        for b in firsts(read()):
            shared.add(b.num_rows)
            yield b

    monkeypatch.setattr(passages, "_firsts", counted)
    rows = passages.repeated_passages(docs).collect()
    windows = sum(len(r.text[r.start : r.start + r.length].encode().translate(FOLDED).split()) - 49 for r in spark.createDataFrame(rows).join(docs, "doc_id").collect())
    assert 0 < counts.value < windows / 4 and 0 < shared.value < windows / 4


def test_runs_give_back_their_windows(spark):
    rng, w = np.random.default_rng(2), lambda n, gap: "".join(f"é{i}{' ' * k}" for i, k in enumerate(gap.tolist()[:n]))
    texts = [(k, w(150 + k, np.where(rng.random(400) < 0.01, 300, 1)) + "\n\n" + w(80, rng.integers(1, 4, 80)).replace("7", "7\n")) for k in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    for often in (np.zeros(0, np.uint64), np.sort(rng.integers(0, 1 << 62, 50, np.uint64))):
        passing = spark.sparkContext.broadcast((np.full(1 << 17, 255, np.uint8), often))
        want = {(r.h, r.doc_id, r.at, r.place) for r in passages._candidates(docs, 50, passing, False).collect()}
        got, kinds = [], set()
        for t in (passages._runs(docs, 50, passing).toArrow(), passages._runs(docs, 50, passing).limit(5).toArrow()):
            of, h, at, place = passages._told(t)
            got.append(list(zip(h.view(np.int64).tolist(), t["doc_id"].to_numpy()[of].tolist(), at.tolist(), place.tolist())))
            kinds |= {8 * len(s) // len(x) for s, x in zip(t["steps"].to_pylist(), t["hashes"].to_pylist())}
        assert set(got[0]) == want and len(got[0]) == len(want) > len(t) and set(got[1]) <= want and kinds == {3, 12}


def test_bands_of_several_classes_are_found_without_a_shuffle(spark):
    classes = spark.range(5000).selectExpr("id", "xxhash64(id) as b0", "xxhash64(id div 2, 1) as b1")
    across = written(spark.range(1000).selectExpr("xxhash64(id, 1) as band"), "bands")
    found = paragraphs.in_bands(classes, across)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = {(r.id, r.band) for r in found.collect()}
    want = {(r.id, r.b1) for r in classes.where("id < 2000").collect()}
    assert want <= got and len(got) < len(want) + 1000


def test_very_common_windows_are_rows_by_runs(spark, monkeypatch):
    shared, rows = [f"p{i}" for i in range(200)], []
    for k in range(300):  # 151 windows of the passage in each, with lines and spaces of its own, and rows that repeat a doc_id with other lines
        text = " ".join(f"{w}\n" if k % 7 == 1 and i % 50 == 9 else w for i, w in enumerate(shared))
        text = text.replace("p60 ", "p60" + " " * 400) if k % 5 == 0 else text
        rows += [(k % 290, f"a{k} b{k}\n{text} c{k}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    made, common, seen = [], passages._common, passages._seen
    monkeypatch.setattr(passages, "_common", lambda rows, few: [made.append(rows.count()), out := common(rows, few), made.append(out.count())][1])
    monkeypatch.setattr(passages, "_seen", lambda rows: made.append((found := seen(rows)).count()) or found)
    want = sorted(map(tuple, passages.repeated_passages(docs).collect()))
    assert not made and len({r[0] for r in want}) == 290
    for few in (200_000, 0):
        assert sorted(map(tuple, passages.repeated_passages(docs, often=0, few=few).collect())) == want
    every = 300 * 151
    assert len(made) == 6 and max(made) < every / 5  # runs, first occurrences and passages, looked up by broadcast or by joins


def test_first_occurrences_of_runs_are_those_of_windows(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(2)
    passing = spark.sparkContext.broadcast((np.full(1 << 17, 255, np.uint8), np.zeros(0, np.uint64)))
    windows, each, got = [tuple(r) for r in passages._candidates(docs, 50, passing, True).collect()], defaultdict(list), defaultdict(list)
    for h, doc_id, at, _ in windows:
        each[h].append((doc_id, at))
    runs = written(passages._runs(docs, 50, passing, True), "runs")
    for r in passages._seen(runs).collect():
        got[r.h].append((r.doc_id, r.at, r.high))
    assert {h: (min(x)[:2], max(y[2] for y in x)) for h, x in got.items()} == {h: (min(x), max(x)[0]) for h, x in each.items()}
    batches = runs.toArrow().to_batches(50)
    for most, parts in ((1, len(runs.toArrow())), (1 << 14, None), (1 << 40, len(batches))):
        monkeypatch.setattr(passages, "UNPACKED", most)
        opened = list(passages._opened(iter(batches)))
        assert sorted(x for _, _, c in opened for x in zip(*(v.tolist() for v in c))) == sorted(windows) and len(opened) == (parts or len(opened))

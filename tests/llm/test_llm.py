"""The training-data operators against brute force, and on nulls, empty texts and empty tables."""

import itertools
import zlib

import numpy as np
import pytest
import xxhash

from gleaner.llm import decontaminate, embeddings, licenses, packing, paragraphs, pii, quality, sharding, simhash, url_filter, verify

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, label string, cell string"
ODD = [(1, None, None, "x"), (2, "", "a", None), (3, "one two", None, None), (3, "one two", None, None), (None, "one two", "n", "n"), (4, "wörd " * 5000, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_classes(docs):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    for r in docs.limit(20).collect():
        w = r.text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert got[r.doc_id][0] == sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
    linked = [(a, b) for a, b in itertools.combinations(got, 2) if (got[a][0] ^ got[b][0]).bit_count() <= 4]
    assert components(got, linked) == {k: v[1] for k, v in got.items()}


@pytest.mark.parametrize("t", [1, 4, 7, 12])
def test_covering_finds_every_pair(t):
    rng = np.random.default_rng(t)
    x = rng.integers(0, 1 << 63, 300, np.int64)
    flips = np.zeros(300, np.int64)
    for i in range(300):
        for b in rng.choice(63, t, replace=False):
            flips[i] |= 1 << int(b)
    plan, met = simhash.blocks(t), np.zeros(300, bool)
    for shift, within, code in plan:
        cut = lambda v: (v >> shift) & ((1 << code.n) - 1)
        at, to = code.visits(cut(x ^ flips), within)
        met[at[code.home(cut(x))[at] == to]] = True
    assert met.all() and sum(w + 1 for _, w, _ in plan) == t + 1


def test_stage_keeps_one_of_each_group(docs):
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {k: np.unique(simhash.shingle_hashes(v.encode(), 5)) for k, v in texts.items()}
    ids = list(sets)
    linked = [(ids[i], ids[j]) for i, j in verify.similar_pairs([sets[k] for k in ids], 0.8)]
    want = {k for k, v in components(ids, linked).items() if k == v}
    assert want <= kept and len(kept - want) <= 0.1 * max(1, len(linked))


def test_leaks_and_clean(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string")
    rows = [(1, f"some words here {item.upper()}, and more"), (2, "a tiny item"), (3, "clean text of its own"), (4, None), (5, item.replace("eta", "x"))]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(some, bench).collect()}
    assert got == {(1, 1), (2, 4)}
    assert {r.doc_id for r in decontaminate.clean(some, bench).collect()} == {3, 4, 5}
    assert {r.doc_id for r in decontaminate.leaks(some, bench, items_each=1).collect()} == {1, 2}


def test_repeated_paragraphs(spark):
    line = " ".join(f"w{i}" for i in range(60))
    near = line.replace("w59", "other")
    rows = [(1, f"intro\n{line}"), (2, f"{line}\nelse"), (3, near), (4, " ".join(f"v{i}" for i in range(60))), (5, None), (6, "")]
    got = {(r.doc_id, r.start, r.kept, r.cluster_doc) for r in paragraphs.repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 6, True, 1), (2, 0, False, 1), (3, 0, False, 1)}


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_embeddings_recall(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base[:5]])
    rows = [(i, v.tolist(), i % 40 % 3) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, x[0].tolist(), None)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    label = np.arange(len(x)) % 40 % 3
    n = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_shards_are_near_equal_and_gapless(docs):
    rows = sharding.shards(docs).collect()
    by = {s: [r for r in rows if r.shard == s] for s in range(24)}
    assert len(rows) == docs.count() and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in list(texts)[:40]:
        pieces = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert sum((list(r.ids) for r in pieces), []) == [*reader.encode(texts[k], add_special_tokens=False).ids, 0]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all(b[1] == (a[1] + a[2]) % 1024 and b[0] == a[0] + (a[1] + a[2]) // 1024 for a, b in zip(places, places[1:]))


def test_pseudonyms_keep_format_and_identity():
    key = b"k"
    assert len({pii.permuted(n, 1000, key, b"t") for n in range(1000)}) == 1000
    text = "4845168114407329 and 4845-1681-1440-7329, +1 (017) 555-7713, 9807915762804491, 2024-02-29"
    new, found = pii.pseudonymised(text, key)
    first, second = new.split(" and ")[0], new.split(" and ")[1].split(",")[0]
    assert second.replace("-", "") == first != "4845168114407329" and pii.luhn_digit(first[:-1]) == first[-1]
    assert "9807915762804491" in new and found["card"] == 2 and found["phone"] == 1 and found["date"] == 1


def test_url_aliases(spark):
    rows = [(1, "http://a.net/x", '<link rel="canonical" href="http://b.org/x">'), (2, "http://b.org/x", ""), (3, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://b.org/x">'), (4, None, None), (5, "http://www.Example.net/en/1?q", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("net/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow"), 5: ("example.net/en/", "allow")}


def test_licence_texts(spark):
    mit = licenses.TEXTS["MIT"].replace("MIT License", "MIT Licence").replace("\n\n", "\n\nCopyright (c) 2020 Somebody\n\n", 1).upper()
    rows = [(1, mit), (2, "text\nReleased under the MIT licence!"), (3, None), (4, ""), (5, "Released under the MIT License of some")]
    got = {(r.doc_id, r.unit, r.line, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "document", None, "MIT"), (2, "line", 1, "MIT")}


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (3, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    n = len(rows)
    assert simhash.near_duplicates(docs).count() == n
    assert quality.score(docs, labels).count() == n
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert quality.accepted(docs, labels.limit(0)).count() == n
    assert sharding.shards(docs).count() == n
    assert pii.pseudonymise(docs, b"k").count() == pii.pseudonymise(docs, b"k", keep=True).count() == n
    assert decontaminate.leaks(docs, bench).count() == (3 if n else 0)
    assert simhash.drop_near_duplicates(docs).count() == (4 if n else 0)
    assert packing.pack(docs).select("doc_id", "start").count() >= n
    assert licenses.scan(docs).count() == paragraphs.repeated_paragraphs(docs).count() == 0


@pytest.mark.parametrize("block", [8, 1 << 17])
def test_thinned_edges_have_the_same_components(spark, block):
    from gleaner.llm.common import written
    from gleaner.operators.components import connected_components, thinned

    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (60, 2))] + [(a, b) for a in range(200, 225) for b in range(200, 225)]
    rows = [(*p, ) for p in pairs] + [(None, 7), (5, 5)]
    thin = thinned(written(spark.createDataFrame(rows, "a long, b long"), "test"), block)
    got = {r.node: r.component for r in connected_components(thin).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    assert got == components(sorted({x for p in real for x in p}), real)
    assert thin.count() < len(rows) and thinned(written(spark.createDataFrame([], "a long, b long"), "test"), block).count() == 0

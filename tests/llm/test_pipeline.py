"""The whole pipeline, and its stages against plain computations over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import decontaminate, paragraphs, pii, quality, simhash, verify
from gleaner.llm.common import BATCH, read

from .test_llm import DATA, components

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_of(texts: dict, alike=0.8):
    """The smallest id of each group of texts whose sets of shingles have that similarity; texts without words are alike."""
    sets = {k: np.unique(simhash.shingle_hashes(v.encode(), 5)) for k, v in texts.items()}
    ids = sorted(sets)
    linked = [(ids[i], ids[j]) for i, j in verify.similar_pairs([sets[k] for k in ids], alike)]
    return {k for k, v in components(ids, linked).items() if k == v}


def test_stages_over_the_documents(spark):
    docs, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
    at, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DATA).cache()
        at[name] = kept
    for name in names[:-1]:
        assert at[name].columns == docs.columns
    ids = {n: [r.doc_id for r in at[n].select("doc_id").collect()] for n in names[:-1]}
    scored = {r.doc_id: r.predicted for r in quality.score(docs, labels).collect()}
    assert sorted(ids["quality classifier"]) == sorted(k for k, v in scored.items() if v == 1)
    texts = {r.doc_id: r.text for r in at["quality classifier"].collect()}
    assert sorted(ids["simhash near-dedup"]) == sorted(kept_of(texts))  # no link is lost, and none is made up
    found = {r.doc_id for r in decontaminate.leaks(at["simhash near-dedup"], read(spark, DATA, "benchmark")).collect()}
    assert sorted(ids["benchmark decontamination"]) == sorted(set(ids["simhash near-dedup"]) - found)
    key = pii.session_key(spark, corpus_pipeline.queries.DEMONSTRATION)
    assert {r.doc_id: r.text for r in at["pii"].collect()} == {k: pii.pseudonymised(texts[k], key)[0] for k in ids["benchmark decontamination"]}
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.columns == at["packing"].columns and packed.select("doc_id").distinct().count() == len(set(ids["pii"]))
    order = ["doc_id", "start"]
    some = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    whole = {k: n for k, n in (tuple(r) for r in packed.groupBy("doc_id").agg(F.sum("length")).collect())}
    assert all(whole[r.doc_id] == r.doc_tokens for r in packed.select(*some).orderBy(*order).collect())


ODD = [
    (1, None, None, None, None), (2, "", "en", "web", 0), (3, "one two", None, None, 7), (3, "one two", None, None, 7), (None, "one two", "en", None, 7), (None, None, None, None, None),
    (4, "wörd " * 50_000, "de", "", 1), (5, "\n \t\n", "en", "web", 4), (6, "a@b.example.org " * 20, "en", "web", 3),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_and_empty_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Without labels all stay; of 1, 2 and 5, which have no words, the first; of the rows of 3 one; null ids stay as they are.
    want = [1, 3, 4, 6, None, None] if rows else []
    assert sorted((r.doc_id for r in got if r.start == 0), key=lambda k: (k is None, k)) == want
    assert all(0 < r.length <= 1024 and r.doc_tokens >= 1 for r in got)


CLASHING = "doc_id long, text string, id long, group string, count int, band string, n int, fp string, score string, predicted int, component long, _n string, _c int, own int, h string"


def test_columns_with_the_names_of_inner_ones(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(k, t, 7, "g", 1, "b", 2, "f", "s", 0, 9, "n", 1, 2, "h") for k, t in ((1, line), (2, line + " more"), (3, "else where"), (3, "quite another"), (None, line))]
    docs = spark.createDataFrame(rows, CLASHING)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, line), (1, line), (3, "else where"), (3, "quite another")])
    assert quality.accepted(docs, labels).columns == docs.columns and quality.score(docs, labels).count() == 5
    assert pii.pseudonymise(docs, b"k", keep=True).columns == docs.columns
    assert decontaminate.clean(docs, spark.createDataFrame([(1, "else where")], "item_id long, text string")).count() == 4
    assert {(r.doc_id, r.kept) for r in paragraphs.repeated_texts(docs).collect()} == {(1, True), (2, False)}
    assert simhash.near_duplicates(docs).count() == 5


def test_near_duplicates_in_blocks_of_few_shingles(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 30, n)]
    texts = {}
    for i in range(12):
        base = words(120)
        for j in range(10):
            part = list(base)
            for _ in range(int(rng.integers(0, 5))):
                part[int(rng.integers(0, 120))] = "x"
            texts[100 * i + j] = " ".join(part)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = kept_of(texts)
    for settings in ({}, {"most_shingles": 300}, {"group_limit": 3, "cell_limit": 4, "few": 0}, {"group_limit": 5, "threshold": 1, "n_bands": 40}):
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs, **settings).collect()} == want


def test_stages_read_texts_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["size"])

    docs = spark.createDataFrame([(k, "some words " * 1000, "en", "web", 11_000) for k in range(2000)], DOCUMENTS).coalesce(1).cache()
    before = spark.conf.get(BATCH, None)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(BATCH)
            stage(spark, docs.limit(10), DATA)
            got = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
            assert sum(got) > 22_000_000 and max(got) < 4_500_000
        spark.conf.set(BATCH, "9m")
        corpus_pipeline.pii_stage(spark, docs, DATA)
        assert spark.conf.get(BATCH) == "9m"
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
        docs.unpersist()


def test_addresses_in_other_cases_stay_linked():
    from gleaner.llm.pii import pseudonymised

    one, other, third = (pseudonymised(f"write to {x} now", b"k")[0].split()[2] for x in ("bob.k7@x.org", "Bob.K7@x.org", "BOB.k7@X.ORG"))
    assert one != "bob.k7@x.org" and one.split("@")[0] == one.split("@")[0].lower()
    assert other.lower() == one and third.lower() == one and other != one and other[0].isupper()


def test_a_known_key_is_warned_of(spark, caplog):
    from gleaner.llm import pii

    assert pii.session_key(spark, b"known") == b"known" and "not set" in caplog.text

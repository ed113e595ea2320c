"""Repeated paragraphs however their lines are cut."""

import numpy as np
import pytest

from gleaner.llm import paragraphs


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def wrapped(w, each):
    return "\n".join(" ".join(w[k : k + each]) for k in range(0, len(w), each))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("each, around", [(120, "\n"), (120, " "), (60, "\n\n"), (24, "\n"), (12, "\n"), (12, " "), (3, "\n\n")])
def test_near_copies_in_lines_of_any_length(spark, each, around):
    rng = np.random.default_rng(each)
    shared, rows, spans = words(rng, 120), [], {}
    for d in range(20):
        copy = list(shared)
        copy[int(rng.integers(0, 120))] = f"other{d}"  # two copies differ in two words: similarity 0.84
        before, own = wrapped(words(rng, 150), 13 if each < 60 else 75), wrapped(copy, each)
        rows.append((d, f"{before}{around}{own}{around}{wrapped(words(rng, 40), 40)}"))
        spans[d] = len(before) + len(around), len(before) + len(around) + len(own)
    rows += [(100 + d, wrapped(words(rng, 200), 9 + d)) for d in range(10)]
    got = paragraphs.repeated_texts(table(spark, rows)).collect()
    found = {}
    for r in got:
        low, high = spans[r.doc_id]
        inside = set(range(max(low, r.start), min(high, r.start + r.length)))
        assert len(inside) >= 0.7 * r.length  # and not much besides
        found.setdefault(r.doc_id, set()).update(inside)
    if around == " " and each == 120:
        assert len(found) >= 15  # within a line of 235 words, where only its words choose what is compared
    else:
        assert len(found) == 20
        assert np.mean([len(found[d]) / (b - a) for d, (a, b) in spans.items()]) > (0.6 if each < 60 else 0.25)
    assert all(r.kept for r in got if r.doc_id == 0)


def test_short_lines_that_repeat(spark):
    rng = np.random.default_rng(5)
    line, small, tiny = " ".join(words(rng, 24)), " ".join(words(rng, 5)), "only four words here"
    rows = [(d, "\n".join([" ".join(words(rng, 30)), x, " ".join(words(rng, 31))])) for d, x in enumerate([line, line, small, small, tiny, tiny])]
    got = {(r.doc_id, r.cluster_doc, r.kept): r for r in paragraphs.repeated_texts(table(spark, rows)).collect()}
    assert set(got) == {(0, 0, True), (1, 0, False)}  # a sentence that texts share is no passage
    assert rows[1][1][got[1, 0, False].start :][: got[1, 0, False].length] == line
    layout = paragraphs.Layout(shortest=5)
    assert {(r.doc_id, r.kept) for r in paragraphs.repeated_texts(table(spark, rows), layout).collect()} == {(0, True), (1, False), (2, True), (3, False)}
    whole = [(d, f"{tiny} and more") for d in range(2)] + [(d, tiny) for d in range(2, 4)]
    assert {(r.doc_id, r.kept) for r in paragraphs.repeated_texts(table(spark, whole)).collect()} == {(0, True), (1, False)}


def test_every_word_is_within_a_unit():
    import pyarrow as pa

    from gleaner.llm.words import Grams, chunks

    rng = np.random.default_rng(6)
    texts = ["\n".join(" ".join(words(rng, int(n))) for n in rng.integers(0, 40, int(rng.integers(1, 12)))) for _ in range(300)] + [wrapped(words(rng, 3000), 3000), "a b c d", "", "a\nb\nc\nd\ne"]
    for _, _, c in chunks(pa.array(texts), 5000):
        x = paragraphs.Units(c, Grams(), paragraphs.Layout())
        held = np.zeros(len(c.start), bool)
        for low, high, doc in zip(x.low, x.high, x.doc):
            held[low:high] = True
            assert high - low >= 5 and c.bounds[doc] <= low and high <= c.bounds[doc + 1]
        assert held[np.repeat(c.count >= 5, c.count)].all() and not held[np.repeat(c.count < 5, c.count)].any()
        own = np.sort(x.low[~x.whole])
        assert (np.diff(own) > 5).all() or len(set(c.doc[own])) > 1

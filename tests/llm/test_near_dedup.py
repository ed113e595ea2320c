"""Near copies that SimHash alone puts outside of its radius."""

import numpy as np

from gleaner.llm import simhash


def test_repeated_lines_and_short_texts(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []
    for i in range(40):
        long, short, part = words(300), words(8), words(100)
        pairs = [(long, long + long[:10] * 30), (short, [*short, *words(1)]), (part, part[:20] * 4 + part)]
        rows += [(6 * i + 2 * j + k, " ".join(p[k])) for j, p in enumerate(pairs) for k in (0, 1)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 240, 2))

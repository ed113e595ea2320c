"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, written

CLASSES = {
    "digit": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "space": b" \t", "stop": b".,;:?",
    "bang": b"!", "pipe": b"|", "symbol": b"#$%&*@^~_=+<>{}[]\\/`", "quote": b"'\"()-", "high": bytes(range(128, 256)),
}
STATISTICS = 10 + len(CLASSES)


def statistics(data: bytes) -> list[float]:
    """Statistics of a whole text; all zero for an empty one."""
    if not data:
        return [0.0] * STATISTICS
    words, lines = data.split(), data.split(b"\n")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    seen = Counter(words)
    n, lengths = max(1, len(words)), np.fromiter(map(len, words), np.int64, len(words))
    out = [np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), len(words) / len(lines)]
    out += [lengths.mean() if len(words) else 0, lengths.std() if len(words) else 0, len(seen) / n, max(seen.values(), default=0) / n]
    out += [1 - len(set(lines)) / len(lines), sum(w[-1:].isalnum() or w[-1:] >= b"\x80" for w in seen) / max(1, len(seen))]
    return [float(x) for x in out] + [float(counts[list(c)].sum()) / len(data) for c in CLASSES.values()]


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)``: the statistics of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in utf8(b.column(1))], np.float64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * STATISTICS), pa.array(rows))
            yield pa.record_batch([b.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, whose products approximate a Gaussian kernel; a constant last."""
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1: the calibrated value, and a thousandth of the raw one so that its order stays within plateaus."""
        raw = self.expand(x) @ self.weights
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x of each pool) and their increasing levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, a, 1.0])
        while len(pools) > 1 and pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[1] / p[2] for p in pools]), np.array([p[0] / p[2] for p in pools])


def sampled(labels: DataFrame, most_rows: int, seed: int) -> DataFrame:
    """``(doc_id, y)``: at most about ``most_rows`` labelled documents that are not held out, all where there are no more.

    They are those whose hash is below a threshold that their count gives, so that no task ranks or gathers them. The
    threshold is two in a hundred lower than the share: the number stays under ``most_rows``.
    """
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    marks = written(marks, "marks")
    n = marks.count()
    if n <= most_rows:
        return marks
    return marks.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * most_rows * 0.98 / n))


def fit(docs: DataFrame, labels: DataFrame, size: int = 256, ridge: float = 1e-3, width: float = 1.0, most_rows: int = 200_000, parts: int = 16, seed: int = 11) -> Model | None:
    """A model from ``docs(doc_id, text)``, or ``(doc_id, x)`` with statistics made before, and ``labels(doc_id, quality)``; None where no row is labelled.

    ``most_rows`` is the bound of the sample of labelled documents, and the only bound there is; its ids (16 bytes each) are
    broadcast, and only those documents' texts are read for it. Each partition sums its share of the normal equations; the
    ``parts`` sums of fixed size are added on the driver. A fifth of the rows is kept out of them for the calibration;
    with fewer than 50 rows all of them serve for both.
    """
    chosen = F.broadcast(sampled(labels, most_rows, seed).withColumnRenamed("doc_id", "_id"))
    rows = docs.join(chosen, F.col("doc_id") == F.col("_id"))
    if "x" not in docs.columns:
        rows = features(rows.select("doc_id", "text")).join(chosen, F.col("doc_id") == F.col("_id"))
    rows = written(rows.select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("apart")).repartition(parts), "training")
    first = rows.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not first[0]:
        return None
    moments = np.array(first[1:], np.float64).reshape(-1, 2)
    scale = np.where(moments[:, 1] > 1e-9, moments[:, 1], 1)
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(STATISTICS, size)) / (width * np.sqrt(STATISTICS))
    model = Model(moments[:, 0], scale, directions, rng.uniform(0, 2 * np.pi, size), np.zeros(size + 1), np.zeros(1), np.zeros(1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size + 1, size + 2))
        for b in batches:
            x, y = b.column(0).flatten().to_numpy().reshape(-1, STATISTICS), b.column(1).to_numpy()
            for low in range(0, len(y), 4096):
                z = model.expand(x[low : low + 4096])
                a += np.hstack([z.T @ z, (z.T @ y[low : low + 4096])[:, None]])
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary())], names=["a"])

    total = sum(np.frombuffer(r.a).reshape(size + 1, size + 2) for r in rows.where("not apart").select("x", "y").mapInArrow(sums, "a binary").collect())
    penalty = ridge * max(1.0, total[-1, -2]) * np.eye(size + 1)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, STATISTICS)
            yield pa.record_batch([pa.array(model.expand(x) @ model.weights), b.column(1)], names=["r", "y"])

    kept = rows.where("apart") if first[0] >= 50 else rows
    pairs = [(r.r, r.y) for r in kept.select("x", "y").mapInArrow(raw, "r double, y double").collect()]  # at most most_rows / 5
    model.knots, model.levels = isotonic(*np.array(pairs).reshape(-1, 2).T) if pairs else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def held_out() -> F.Column:
    """True where crc32 of the doc_id as text leaves remainder 1 by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns as they are; one pass over the texts.

    The same rules as for ``score``; without any labelled row all rows stay. Other columns never matter, whatever their names.
    """
    model = fit(docs.select("doc_id", "text"), labels, **settings)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column(b.schema.get_field_index("text")).cast(pa.string()))
            x = np.array([statistics(t) for t in texts], np.float64).reshape(-1, STATISTICS)
            yield b.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Quality of every whole text: ``(doc_id, held_out, score, predicted)``, a row for each input row.

    score is between 0 and 1, higher where label 1 is likelier; predicted is 1 if it is 0.5 or more, else 0. Only labels of
    rows that are not held out are learned from; the inputs of a score are statistics of the text alone.

    Null and empty texts are scored as texts whose statistics are all zero, and texts of any length whole. Repeated rows are scored each, and learned
    from each; a document labelled more than once counts with its largest label. A null doc_id is scored, not held out and
    not learned from. Without any labelled row every score is 0.5. An empty table gives none. Extra columns are ignored.
    """
    table = written(features(docs), "features")
    model = fit(table, labels, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

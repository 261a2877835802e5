"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. One pass over the texts gives each document a few statistics (length, word shapes,
   character classes, repetition); they are stored, texts are not read again.
2. A bounded, hash-ordered sample of the labelled rows is the training table. Its
   statistics are standardised and mapped to random Fourier features, cosines whose dot
   products approximate a Gaussian kernel.
3. Ridge scores solve the normal equations. Each partition adds up its own feature
   products; the sums of the partitions are added in Spark, so that what reaches the
   driver is one matrix of the features' size.
4. Rows kept out of the fit calibrate the scores: their labels, averaged by rounded
   score, are made monotone by pooling adjacent violators and interpolated between.

Scores come from the statistics of the text alone; labels, languages, sources and ids
are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted

TRAIN_ROWS = 40_000     # labelled rows at most in the training table
PARTS = 8               # partitions of the training table
FEATURES = 256          # random Fourier features
WIDTH = 2.0             # of the Gaussian kernel, on standardised statistics
RIDGE = 1e-3            # times the number of rows
CALIBRATE_OF = 4        # one training row in so many calibrates instead of fitting
SCORE_STEP = 0.001      # scores are rounded to this for calibration
THRESHOLD = 0.7

STATS = ("words", "word_chars", "distinct", "top_word", "trigrams", "neighbours", "dup_lines",
         "line_words", "symbols", "digits", "capitals", "marks", "non_ascii")
_SYMBOLS = b"#*$%&|<>{}[]^~\\/=_+@"
_DIGITS = b"0123456789"
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!?;:"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics named in ``STATS``; a text without words has zeros but for length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    if n == 0:
        return [0.0] * len(STATS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    return [
        float(np.log1p(n)), sum(map(len, words)) / n, len(set(words)) / n,
        Counter(words).most_common(1)[0][1] / n,
        len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1.0 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        share(_SYMBOLS), share(_DIGITS), share(_CAPITALS), share(_MARKS), share(_HIGH)]


def document_statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, stats) of every row, in one pass over the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, stats array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_table(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality",
                   rows: int = TRAIN_ROWS) -> DataFrame:
    """(stats, y, calibrates) of at most ``rows`` labelled rows that are not held out,
    first by hash of the id; repeated labels of an id are averaged, nulls left out. Of rows
    that share an id but not a text the one with the least statistics is learned from."""
    given = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    given = given.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.avg(F.col(label).cast("double")).alias("y")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit("train"), "doc_id")
    sample = given.orderBy(order, "doc_id").limit(rows)
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE_OF)) == 0
    # at most ``rows`` rows by construction
    once = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("stats").alias("stats"))
    return once.select("doc_id", "stats", "y", calibrates.alias("calibrates"))


class Model:
    """Standardisation, Fourier features, ridge weights and calibration curve."""

    def __init__(self, mean, std, features: int = FEATURES, width: float = WIDTH, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = np.asarray(mean), np.asarray(std)
        self.omega = rng.normal(0.0, 1.0 / width, (len(self.mean), features))
        self.phase = rng.uniform(0.0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.level = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -5.0, 5.0)
        z = np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.omega + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.level), 0.0, 1.0)


def _stack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, float).reshape(len(rows), len(STATS))


def normal_equations(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of z z', sum of z y, rows): summed in each partition, then over them in Spark."""
    size = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            z = model.features(_stack(b.column(0)))
            total += z.T @ np.column_stack([z, b.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    parts = train.select("stats", "y").mapInArrow(run, "i int, v array<double>")
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((size, size + 1))
    for i, j, v in cells.collect():  # (features + 1)^2 cells, whatever the input
        total[i, j] = v
    return total[:, :-1], total[:, -1], int(round(total[-1, -2]))


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, level) of each block, centres and levels rising."""
    blocks: list[list[float]] = []
    for x, v, w in zip(at, y, weight):
        blocks.append([x * w, v * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrate(rows: DataFrame, model: Model) -> None:
    """Set the model's calibration curve from rows that it was not fitted to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = model.raw(_stack(b.column(0)))
            steps = np.round(np.clip(raw, -1.0, 2.0) / SCORE_STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(steps), b.column(1)], ["step", "y"])

    by = rows.select("stats", "y").mapInArrow(run, "step int, y double").groupBy("step").agg(
        F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    got = sorted(tuple(r) for r in by.collect())  # at most 3 / SCORE_STEP rows
    if got:
        step, y, n = (np.array(c, float) for c in zip(*got))
        model.at, model.level = isotonic(step * SCORE_STEP, y, n)


def fit(train: DataFrame) -> Model:
    """The model of a stored training table; without rows every score is 0.5."""
    fitting = train.where(~F.col("calibrates"))
    each = [F.col("stats")[i] for i in range(len(STATS))]
    sums = fitting.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).head()
    if sums[0] is None:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    mean, std = np.array(sums[:len(STATS)]), np.array(sums[len(STATS):])
    model = Model(mean, np.where(std > 1e-9, std, 1.0))
    zz, zy, n = normal_equations(fitting, model)
    model.weights = np.linalg.solve(zz + RIDGE * n * np.eye(len(zz)), zy)
    held = train.where("calibrates")
    calibrate(fitting if held.isEmpty() else held, model)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Edge cases: null, empty and blank texts have the statistics of no words and are
    scored like any other; a null id is not held out and never trained on; repeated rows
    are scored one by one and trained on once; without usable labels every score is 0.5;
    an empty table gives an empty result; other columns play no part.
    """
    stats = persisted(document_statistics(docs, id_col, text))
    train = persisted(training_table(stats, labels, id_col, label, rows).repartition(PARTS, "doc_id"))
    model = docs.sparkSession.sparkContext.broadcast(fit(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(model.value.score(_stack(b.column(1))), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

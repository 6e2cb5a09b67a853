"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

1. One pass makes 16 statistics of each whole text.
2. Labelled rows are standardised and mapped to cosines of random projections,
   which approximate a Gaussian kernel; each partition sums its part of the
   normal equations, and the driver adds a bounded number of those parts.
3. Isotonic regression turns ridge scores into probabilities, on labelled rows
   that the ridge fit did not see.
4. Scoring is one more pass over the statistics.

doc_id, lang, source and labels are inputs of no score. Each row is scored by
its text alone, whatever its doc_id is and however often it comes; null, empty
and blank texts have statistics of 0 and the score of those. A text of any
length is one row, of which the words are held at once. An empty table gives an
empty one, and other columns are not looked at. Labels without a doc_id or with
another quality than 0 and 1 are passed over; a document with both counts as 1.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, map_arrow, text_or_empty, written
from strandlake.llm.words import buffers, groups, word_runs

#: Labelled rows that a fit reads at most, in the order of a hash of doc_id.
MOST_LABELS = 2_000_000
FEATURES, SIGMA, RIDGE = 384, 3.0, 1e-3
#: Parts of the normal equations that the driver adds; steps of the calibration.
PARTS, STEPS = 16, 2000
THRESHOLD = 0.3
N_STATS = 16

# Classes of bytes.
_CLASS = np.full(256, 9, np.uint8)  # other
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"|", b"#$%&*@=<>{}[]^~_/\\+`")):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 10
_CLASSES = 11


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def statistics(texts: pa.Array) -> np.ndarray:
    """texts x N_STATS."""
    raw, offsets = buffers(texts)
    out = np.zeros((len(texts), N_STATS), np.float64)
    for a, b in groups(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        kinds = _CLASS[part]
        words, starts, ends, first = word_runs(part, at)
        lengths = (ends - starts).astype(np.float64)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        for k in range(b - a):
            s, e, i, j = at[k], at[k + 1], first[k], first[k + 1]
            row = out[a + k]
            n, m = e - s, j - i
            if m == 0:
                continue
            c = np.bincount(kinds[s:e], minlength=_CLASSES)
            letters = max(1, c[0] + c[1] + c[10])
            w = lengths[i:j]
            distinct = len(np.unique(words[i:j]))
            p = c[c > 0] / n
            row[:] = (
                np.log1p(m), w.mean(), w.std(), c[0] / letters, c[2] / n, c[8] / n, c[6] / n, c[7] / n, c[5] / n, (c[3] + c[4]) / n,
                c[10] / n, np.log1p(m / (c[4] + 1)), distinct / m, same[i + 1 : j].sum() / m, np.log(distinct) / np.log(m + 1), -(p * np.log(p)).sum(),
            )
    return out


@dataclass
class Model:
    """What scoring needs; without labels of both kinds, constant is every score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), self.at, self.level)


def features(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, with a constant one."""
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, 1 / SIGMA, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing levels at sorted places, the weighted least-squares fit (pooled adjacent violators)."""
    blocks: list[list[float]] = []
    for place, level, weight in zip(x, y, n, strict=True):
        blocks.append([level, weight, place, place])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, _, hi = blocks.pop()
            u, t, lo, _ = blocks.pop()
            blocks.append([(v * w + u * t) / (w + t), w + t, lo, hi])
    at = np.array([p for b in blocks for p in (b[2], b[3])])
    return at, np.array([b[0] for b in blocks for _ in range(2)])


def _stats_table(docs: DataFrame) -> DataFrame:
    def f(batch: pa.RecordBatch):
        x = statistics(batch.column("text")).astype(np.float32)
        flat = pa.array(x.reshape(-1))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), flat)], ["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), f, "doc_id long, x array<float>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


def marked_rows(labels: DataFrame) -> DataFrame:
    """doc_id and y of labels that a fit may read: outside of the held-out fold, at most about MOST_LABELS; 1 wins where a document has both."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marked.count()
    if n > MOST_LABELS:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * MOST_LABELS / n))
    return written(marked, "labels")


def fit(stats: DataFrame, marked: DataFrame) -> Model:
    """A model from statistics of documents (doc_id, x; others than labelled ones are passed over) and marked_rows."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = written(join_checked(stats, marked, "doc_id", "inner").select("x", "y", (fold == 4).alias("calibrates")).repartition(PARTS), "labelled")
    mean = lambda k: F.avg(F.col("x")[k])
    moments = rows.agg(F.count("y"), F.avg("y"), F.min("y"), F.max("y"), *(mean(k) for k in range(N_STATS)), *(F.stddev_pop(F.col("x")[k]) for k in range(N_STATS))).first()
    if not moments[0] or moments[2] == moments[3]:
        return Model(*[np.zeros(0)] * 5, constant=float(moments[1]) if moments[0] else 1.0)
    model = Model(np.array(moments[4 : 4 + N_STATS]), np.maximum(np.array(moments[4 + N_STATS :]), 1e-6), *[np.zeros(0)] * 3)
    width = FEATURES + 1

    def parts(batches):
        gram, right, rows_ = np.zeros((width, width)), np.zeros(width), 0
        for b in batches:
            if b.num_rows:
                x = features((_matrix(b) - model.mean) / model.scale)
                gram += x.T @ x
                right += x.T @ b.column("y").to_numpy()
                rows_ += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary()), pa.array([rows_])], ["gram", "right_side", "n"])

    gram, right, total = np.zeros((width, width)), np.zeros(width), 0
    fits = rows.where("not calibrates")
    for r in fits.coalesce(PARTS).mapInArrow(parts, "gram binary, right_side binary, n long").toLocalIterator():  # PARTS rows
        gram += np.frombuffer(r.gram).reshape(width, width)
        right += np.frombuffer(r.right_side)
        total += r.n
    model.weights = np.linalg.solve(gram + RIDGE * max(total, 1) * np.eye(width), right)

    def scores(batch: pa.RecordBatch):
        return pa.RecordBatch.from_arrays([pa.array(np.round(model.raw(_matrix(batch)) * STEPS)), batch.column("y")], ["step", "y"])

    marks = map_arrow(rows.where("calibrates"), scores, "step double, y int")
    clipped = F.greatest(F.least("step", F.lit(2.0 * STEPS)), F.lit(-1.0 * STEPS))
    steps = marks.groupBy(clipped.alias("step")).agg(F.avg("y").alias("y"), F.count("y").alias("n")).orderBy("step").collect()  # at most 3 STEPS rows
    if steps:
        model.at, model.level = isotonic(np.array([r.step / STEPS for r in steps]), np.array([r.y for r in steps]), np.array([r.n for r in steps], float))
    else:
        model.at, model.level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    An empty or null text has statistics of 0 and the score of those. With no
    labels the score is 1, with labels of one kind it is that kind.
    """
    stats = written(_stats_table(docs), "statistics")
    model = fit(stats, marked_rows(labels))

    def f(batch: pa.RecordBatch):
        s = np.clip(model.score(_matrix(batch)), 0.0, 1.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = map_arrow(stats, f, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score below THRESHOLD; columns as they were.

    Statistics are computed of labelled documents for the fit, and then once of
    all of them, where they are scored.
    """
    marked = marked_rows(labels)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(_stats_table(join_checked(known, marked.select("doc_id"), "doc_id", "left_semi")), marked)

    def f(batch: pa.RecordBatch):
        return batch.filter(pa.array(model.score(statistics(batch.column("text")).astype(np.float32).astype(np.float64)) >= THRESHOLD))

    return map_arrow(docs, f, docs.schema)

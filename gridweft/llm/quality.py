"""Quality classifier: non-negative positive-unlabelled learning on whole-text features, over all texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, fold, held_out, stored, table
from gridweft.llm.textkit import LOWER, SEPARATOR, Rolling, chunks, tidy, words

THRESHOLD = 0.3
#: Standard deviations at which features are cut, and the ridge of the fit.
CLIP, PENALTY = 8.0, 0.1
#: Bins of the histograms that give the class prior, and the share of positives it must rest on.
BINS, PRIOR_SHARE = 1024, 0.3
#: Bytes of whole texts whose features are worked out together.
FEATURE_BYTES = 1 << 18
#: Tasks that add up what other tasks found.
WAYS = 8
#: Coarse byte classes; pairs of neighbours are counted as well.
_CLASSES = 8


def _class_of() -> np.ndarray:
    out = np.full(256, 6, dtype=np.int64)  # other punctuation
    out[SEPARATOR] = 0
    out[10] = 1
    out[ord("a") : ord("z") + 1] = 2
    out[ord("A") : ord("Z") + 1] = 3
    out[ord("0") : ord("9") + 1] = 4
    out[[ord(c) for c in ".,;:'\"?()-"]] = 5
    out[128:] = 7
    return out


CLASS_OF = _class_of()
#: Bytes 0x21 to 0x7E that are no letters or digits: each has a share of its own.
_SIGNS = np.array([i for i in range(0x21, 0x7F) if not chr(i).isalnum()])
_SIGN_OF = np.full(256, len(_SIGNS), dtype=np.int64)
_SIGN_OF[_SIGNS] = np.arange(len(_SIGNS))
WIDTH = _CLASSES * _CLASSES + len(_SIGNS) + 13


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text of a chunk; zeros for an empty text.

    Shares of neighbouring byte classes and of each sign, then word statistics: repeats of the
    word before, distinct words and word pairs, capitals, signs at ends, lengths and lines.
    """
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, WIDTH))
    size = np.diff(offsets)
    if not len(raw):
        return out
    of = np.repeat(np.arange(n_texts), size)
    kind = CLASS_OF[raw]
    pair = kind[:-1] * _CLASSES + kind[1:]
    same = of[:-1] == of[1:]
    n_pairs = _CLASSES * _CLASSES
    out[:, :n_pairs] = np.bincount((of[:-1] * n_pairs + pair)[same], minlength=n_texts * n_pairs).reshape(n_texts, n_pairs)
    n_signs = len(_SIGNS)
    out[:, n_pairs : n_pairs + n_signs] = np.bincount(of * (n_signs + 1) + _SIGN_OF[raw], minlength=n_texts * (n_signs + 1)).reshape(n_texts, n_signs + 1)[:, :n_signs]
    out[:, : n_pairs + n_signs] /= np.maximum(size, 1)[:, None]

    starts, ends, first = words(raw, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1)
    text = np.repeat(np.arange(n_texts), count)
    per = lambda x: np.bincount(text, weights=x, minlength=n_texts)
    h = Rolling(LOWER[raw]).slices(starts, ends)
    follows = np.zeros(len(h), dtype=bool)
    follows[1:] = text[1:] == text[:-1]
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & follows[1:]
    two = h.copy()
    two[1:] = h[1:] * np.uint64(31) + h[:-1]

    def distinct(x: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, text))
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[order][1:] != x[order][:-1]) | (text[order][1:] != text[order][:-1])
        return np.bincount(text[order], weights=new, minlength=n_texts)

    length = (ends - starts).astype(float)
    last, head = raw[ends - 1] if len(ends) else raw[:0], raw[starts]
    upper = (raw >= 65) & (raw <= 90)
    uppers = np.concatenate([[0], np.cumsum(upper)])
    shout = (uppers[ends] - uppers[starts] >= 2) & (head < 128)
    sign = (CLASS_OF[last] == 6) | (last == 33)
    lone = (length == 1) & ((CLASS_OF[head] == 6) | (CLASS_OF[head] == 5))
    mean = per(length) / some
    lines = np.bincount(of, weights=raw == 10, minlength=n_texts) + 1
    out[:, n_pairs + n_signs :] = np.stack(
        [
            per(again) / some, distinct(h) / some, distinct(two) / some, per(shout) / some, per(sign) / some, per(lone) / some,
            mean / 10, np.sqrt(np.maximum(per(length * length) / some - mean * mean, 0)) / 10, np.log1p(count) / 10,
            np.log1p(size) / 10, count / lines / 100, per(length > 20) / some, (count > 0).astype(float),
        ],
        axis=1,
    )
    out[size == 0] = 0
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.concatenate([x, np.sqrt(x)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    #: Weights of the constant and of the standardised features.
    weights: np.ndarray
    #: Share of label 1 among unlabelled texts, estimated without any label 0.
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_expand(x) - self.mean) / self.scale, -CLIP, CLIP)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def output(self, x: np.ndarray) -> np.ndarray:
        """The classifier g, between -1 and 1 where the fit is good; (g + 1) / 2 estimates the posterior."""
        return self.design(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """About the posterior around 1/2, drawn into (0, 1) without losing the order."""
        return _sigmoid(2 * self.output(x))


def fit_risk(p: np.ndarray, pp: np.ndarray, u: np.ndarray, uu: np.ndarray, prior: float, penalty: float = PENALTY) -> np.ndarray:
    """Weights of the least non-negative unbiased risk under squared loss l(z) = (1 - z)^2 / 4.

    p and u are the mean features of positives and of unlabelled texts, pp and uu the means of
    their outer products: all that the risk of a linear classifier g depends on,
    pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]) with pi the class prior. Its second part
    estimates the risk of the negatives. Where the unbiased risk drives that below 0, it counts
    with the greatest weight c in [0, 1] that leaves it at 0, which is the least of the maximum.
    """
    ridge = penalty * np.eye(len(u))
    ridge[0, 0] = 0

    def solve(c: float) -> tuple[np.ndarray, float]:
        w = np.linalg.solve(prior * (1 - c) * pp + c * uu + ridge, prior * (1 + c) * p - c * u)
        return w, (1 + 2 * w @ u + w @ uu @ w) / 4 - prior * (1 + 2 * w @ p + w @ pp @ w) / 4

    w, negative = solve(1.0)
    low, high = 0.0, 1.0
    for _ in range(40 if negative < 0 else 0):
        c = (low + high) / 2
        w, negative = solve(c)
        low, high = (low, c) if negative < 0 else (c, high)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from two histograms of a score over the same bins.

    The share of unlabelled texts above a score is at least the prior times that of the positives,
    so that the least quotient bounds the prior, and meets it where positives are alone. Scores
    above which fewer than PRIOR_SHARE of the positives lie say too little.
    """
    p, u = (np.cumsum(h[::-1]) / max(h.sum(), 1) for h in (positive, unlabelled))
    ok = p >= PRIOR_SHARE
    return float(np.clip((u[ok] / p[ok]).min(initial=1.0), 0.01, 0.99))


def feature_rows(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in chunks(batch.column("text"), FEATURE_BYTES):
                x = features(raw, offsets).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), clear_text().alias("text")).mapInArrow(tidy(run), "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, WIDTH)


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (x, positive) of what ``part`` makes of a batch: ``size`` numbers.

    Each task adds up its rows; what the tasks found is added up in two levels, so that the driver
    gets WAYS rows however many tasks there are.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column("x")), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    out = rows.select("x", "positive").mapInArrow(tidy(first), "sums binary")
    for ways in (WAYS * WAYS, WAYS):
        out = out.repartition(ways, F.xxhash64("sums")).mapInArrow(tidy(again), "sums binary")
    return sum((np.frombuffer(r["sums"]) for r in out.collect()), np.zeros(size))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """Learn from trusted positives (label 1) and all other rows, taken without their labels.

    rows has doc_id and x (``feature_rows``), stored, as it is read three times; labels has doc_id
    and quality. All rows take part: means and spreads of the features, then the means of their
    products, of which the risk is a function, then histograms of the scores, which give the class
    prior. Labels 0 are never read. Without positives every text scores 1/2.
    """
    positives = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("positive", F.lit(True))
    known = rows.join(positives, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    width, d = 2 * WIDTH, 2 * WIDTH + 1

    def spread(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        e = _expand(x)
        return np.concatenate([[len(x), positive.sum()], e.sum(axis=0), (e * e).sum(axis=0)])

    total = summed(known, spread, 2 + 2 * width)
    n, n_positive = total[:2]
    if not n_positive:
        return Model(np.zeros(width), np.ones(width), np.zeros(d), 0.5)
    mean = total[2 : 2 + width] / n
    model = Model(mean, np.sqrt(np.maximum(total[2 + width :] / n - mean * mean, 0)) + 1e-3, np.zeros(d), 0.5)

    def products(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = model.design(x)
        p = z[positive]
        return np.concatenate([z.T @ z, p.T @ p]).reshape(-1)

    uu, pp = summed(known, products, 2 * d * d).reshape(2, d, d)
    uu, pp = uu / n, pp / n_positive
    # the first row of the products is that of the constant; the order of the scores does not depend on the prior
    model.weights = fit_risk(pp[0], pp, uu[0], uu, 0.5)

    def histogram(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        bins = np.clip((model.output(x) + 2) * (BINS / 4), 0, BINS - 1).astype(np.int64)
        return np.concatenate([np.bincount(bins[positive], minlength=BINS), np.bincount(bins, minlength=BINS)]).astype(float)

    model.prior = estimate_prior(*summed(known, histogram, 2 * BINS).reshape(2, BINS))
    model.weights = fit_risk(pp[0], pp, uu[0], uu, model.prior)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Score every whole text: doc_id, score, predicted; with ``keep``, the documents that pass.

    Null and empty texts are scored by their (zero) features. Rows that repeat a doc_id or have
    none are scored each by its own text. With ``keep``, all columns of the input come back and no
    join is needed; columns named score or predicted don't clash. An empty table stays empty.
    """
    columns = docs.columns
    schema = docs.schema if keep else "doc_id long, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(features(raw, offsets)) for _, _, raw, offsets in chunks(batch.column("text"), FEATURE_BYTES)]
            s = np.concatenate([*parts, np.zeros(0)])
            if keep:
                yield batch.filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    if keep:
        return docs.select(*columns).mapInArrow(tidy(run), schema)
    return docs.select(F.col("doc_id").cast("long"), clear_text().alias("text")).mapInArrow(tidy(run), schema)


def taught(df: DataFrame) -> DataFrame:
    return df.where(fold(F.col("doc_id"), 5) != 0)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(stored(feature_rows(taught(docs.select("doc_id", "text"))), "features"), taught(labels))


def scored(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of rows (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is read once: its features are stored, and learning and scoring read these."""
    rows = stored(feature_rows(table(spark, sf_dir, "documents")), "features")
    model = fit(taught(rows), taught(table(spark, sf_dir, "labels")))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id"), 5, 0), "score", "predicted")

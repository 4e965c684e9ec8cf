"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, fold, held_out, table
from gridweft.llm.textkit import CHUNK, U64, chunks, tidy

#: Character n-grams of these lengths, each hashed to ``BUCKETS`` features.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
MAX_LANGUAGES = 256
#: Values of the hash that draws the rows that teach.
DRAWS = 1 << 30
_BLANK = 0x20


@functools.cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, or a blank for what is no letter; whether it is a letter)."""
    size = 0x110000
    fold_to = np.full(size, _BLANK, dtype=np.uint32)
    letter = np.zeros(size, dtype=bool)
    for i in range(size):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            fold_to[i], letter[i] = ord(low[0]), True
    return fold_to, letter


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of UTF-8 bytes, position of each one's first byte)."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.uint32)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    out = lead.copy()
    for k, (low, high, mask) in enumerate(((0xC0, 0xE0, 0x1F), (0xE0, 0xF0, 0x0F), (0xF0, 0x100, 0x07)), start=1):
        rows = np.flatnonzero((lead >= low) & (lead < high))
        if len(rows):
            value = lead[rows] & mask
            for j in range(1, k + 1):
                value = (value << 6) | (padded[at[rows] + j] & 0x3F)
            out[rows] = np.minimum(value, 0x10FFFF)
    return out, at


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(feature of each n-gram by order, first character of each text, letters in each text).

    Characters that are no letters count as blanks; the n-grams of a text may reach over its end
    into one blank that stands between texts.
    """
    fold_to, letter = _folding()
    points, at = code_points(raw)
    first = np.searchsorted(at, offsets)
    letters = np.concatenate([[0], np.cumsum(letter[points])])[first]
    c = fold_to[points].astype(U64) + U64(1)
    inner = first[1:-1]
    features = []
    key = np.zeros(len(c), dtype=U64)
    for k, n in enumerate(ORDERS):
        key = key * U64(0x100000001B3) + c if n == 1 else key[: len(c) - n + 1] * U64(0x100000001B3) + c[n - 1 :]
        h = ((key + U64(n)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - 14)
        f = h.astype(np.int32) + k * BUCKETS
        if n > 1:  # n-grams over the end of a text
            f = np.concatenate([f, np.full(min(n - 1, len(c)), -1, np.int32)])[: len(c)]
            for j in range(1, n):
                f[inner[inner >= j] - j] = -1
        features.append(f)
    return features, first, np.diff(letters)


@dataclass
class Model:
    languages: list[str]
    #: log P(feature | language), a row for each language; the last column is for no feature.
    weights: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, per_language: int = 5000, smoothing: float = 0.5) -> Model:
    """Count n-grams of labelled rows by language and take smoothed logarithms.

    ``per_language`` bounds the labelled rows read for each language (a hash of doc_id chooses
    them); rows without a language or text teach nothing. Counts are aggregated on the executors;
    the driver receives languages x features numbers at most, whatever the input.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    width = len(ORDERS) * BUCKETS
    counts = np.zeros((width, len(languages)))
    if languages:
        # one scan: each language has a bound of its own on the hash that draws its rows
        bounds = F.create_map(*[F.lit(v) for x in languages for v in (x, DRAWS if sizes[x] <= per_language else int(DRAWS * per_language / sizes[x]))])
        sample = labelled.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(DRAWS)) < F.try_element_at(bounds, F.col("lang")))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(languages), width), dtype=np.int64)
            code = {x: i for i, x in enumerate(languages)}
            for batch in batches:
                lang = np.array([code[x] for x in batch.column("lang").to_pylist()])
                for a, b, raw, offsets in chunks(batch.column("text")):
                    features, first, _ = grams(raw, offsets)
                    of = np.repeat(lang[a:b], np.diff(first))
                    for f in features:
                        total += np.bincount((of * width + f)[f >= 0], minlength=total.size).reshape(total.shape)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["lang", "feature", "n"])

        found = sample.mapInArrow(tidy(count), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
        counts[found["feature"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    weights = np.zeros((len(languages), width + 1), dtype=np.float32)
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS : (k + 1) * BUCKETS] + smoothing
        weights[:, k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(axis=0)).T
    total = np.array([sizes[x] for x in languages], dtype=float) + 1
    return Model(languages, weights, np.log(total / total.sum()))


def text_sums(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities of each text's n-grams by language, its letters).

    A single text of more than ``limit`` bytes is summed in pieces that begin and end with
    characters; each looks as far into the next as its last n-grams reach.
    """
    if len(offsets) > 2 or len(raw) <= 2 * limit:
        features, first, letters = grams(raw, offsets)
        total = np.zeros((len(first) - 1, len(weights)))
        full = np.flatnonzero(np.diff(first) > 0)
        for f in features:
            for k, row in enumerate(weights):
                total[full, k] += np.add.reduceat(row[f], first[:-1][full], dtype=np.float64) if len(full) else 0
        return total, letters

    def next_character(at: int) -> int:
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    total, letters, a = np.zeros((1, len(weights))), 0, 0
    while a < len(raw):
        b = end = next_character(min(a + limit, len(raw)))
        for _ in range(max(ORDERS) - 1):
            end = next_character(end + 1) if end < len(raw) else end
        features, _, _ = grams(raw[a:end], np.array([0, end - a]))
        points, at = code_points(raw[a:b])
        letters += int(_folding()[1][points].sum())
        for f in features:
            total[0] += [row[f[: len(at)]].sum(dtype=np.float64) for row in weights]
        a = b
    return total, np.array([letters])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior) of every row, over its whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Equal
    posteriors go to the language first in alphabetical order. Rows that repeat a doc_id, or have
    none, are texts of their own; very long texts are summed in pieces; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.prior))  # languages x features, both bounded
    languages = [*model.languages, "und"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, prior = shared.value
        for batch in batches:
            best = np.full(batch.num_rows, len(languages) - 1)
            posterior = np.zeros(batch.num_rows)
            for a, _, raw, offsets in chunks(batch.column("text")):
                if len(languages) == 1 or not len(raw):
                    continue
                total, letters = text_sums(raw, offsets, weights)
                some = np.flatnonzero(letters > 0)
                total = total[some] + prior
                total -= total.max(axis=1, keepdims=True, initial=-np.inf)
                p = np.exp(total)
                p /= p.sum(axis=1, keepdims=True)
                if len(some):
                    best[a + some], posterior[a + some] = p.argmax(axis=1), p.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([languages[i] for i in best.tolist()], pa.string()), pa.array(posterior)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), clear_text().alias("text")).mapInArrow(tidy(score), "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2), "lang_pred", "score")

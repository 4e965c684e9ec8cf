"""Exact top-k search by inner product: a Voronoi join over pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import stored, table
from gridweft.llm.textkit import tidy

TOP = 5
SCALE = 256
#: Bounds of the pivots, of which there are about sqrt(rows) / 4, and of the vectors against which
#: every query finds a score that k rows reach.
MIN_PIVOTS, MAX_PIVOTS = 8, 1024
REFERENCES = 4096
#: Vectors of a cell that one task holds, and queries that it scores at a time.
DATA_ROWS = 1 << 16
QUERY_ROWS = 1024


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component as double; null if any is null or not finite, or there are none."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def references(vectors: DataFrame, total: int, n: int = REFERENCES) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): up to about ``n`` distinct vectors, a row of each, chosen by a hash of their contents.

    The hash's bound keeps rows before any are gathered; copies fold by partial aggregates.
    """
    chosen = vectors.withColumn("h", F.pmod(F.xxhash64("v"), F.lit(1 << 30)))
    if total > n:
        chosen = chosen.where(F.col("h") < int((1 << 30) * n / total))
    rows = chosen.groupBy("h", "v").agg(F.min("row").alias("row")).orderBy("h", "v").limit(2 * n).collect()
    if not rows:  # so few distinct vectors that none is below the bound
        rows = vectors.orderBy("row").limit(1).collect()
    return np.array([r["row"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64)


def in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(cell, row, vec_id, v, radius): the nearest pivot of each vector, the distance from it."""
    width = pivots.shape[1]
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            cell = (x @ pivots.T - half).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            radius = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), *(batch.column(c) for c in ("row", "vec_id", "v")), pa.array(radius)], names=["cell", "row", "vec_id", "v", "radius"])

    return vectors.select("row", "vec_id", "v").mapInArrow(tidy(run), "cell long, row long, vec_id long, v array<long>, radius double")


def needed_cells(queries: DataFrame, pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, known: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(cell, row, vec_id, v): each query with each cell that may hold one of its k best.

    Its k-th best score among the reference vectors (itself apart) is one that k rows reach. By
    Cauchy-Schwarz no row of a cell scores more than <q, pivot> + |q| r, with r the cell's
    greatest distance from its pivot; cells for which that is less are not needed.
    """
    width = pivots.shape[1]
    rows, vectors = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                q = _matrix(part.column("v"), width)
                scores = q @ vectors.T  # integers, exact in double
                scores[part.column("row").to_numpy()[:, None] == rows[None, :]] = -np.inf
                n = scores.shape[1]
                reach = np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(q), -np.inf)
                dot = q @ pivots[cells].T
                upper = dot + np.sqrt((q**2).sum(axis=1))[:, None] * radius
                slack = 1e-6 * (1 + np.abs(dot).max(initial=0))
                i, j = np.nonzero(upper >= reach[:, None] - slack)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(cells[j].astype(np.int64)), *(part.column(c).take(take) for c in ("row", "vec_id", "v"))], names=["cell", "row", "vec_id", "v"])

    return queries.select("row", "vec_id", "v").mapInArrow(tidy(run), "cell long, row long, vec_id long, v array<long>")


def _best(rows: np.ndarray, q: np.ndarray, data: tuple[np.ndarray, ...], k: int) -> pa.RecordBatch:
    """The k best of each query among data (rows, ids, vectors), sorted by (id, row)."""
    other, ids, x = data
    score = q @ x.T  # integers, exact in double
    if not np.isin(rows, other).any():
        own = None
    else:
        own = rows[:, None] == other[None, :]
        score[own] = -np.inf
    n = min(k, len(ids))
    edge = np.partition(score, len(ids) - n, axis=1)[:, len(ids) - n] if len(ids) > n else np.full(len(rows), -np.inf)
    i, j = np.nonzero((score >= edge[:, None]) & np.isfinite(score))
    s = score[i, j]
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i] < n
    i, j, s = i[keep], j[keep], s[keep]
    return pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(other[j]), pa.array(ids[j]), pa.array(s.astype(np.int64))], names=["query", "row", "vec_id", "score"])


def local_top(work: DataFrame, width: int, k: int) -> DataFrame:
    """The k best of each query within each part of a cell: (query, row, vec_id, score).

    A part's data (side 0) come first and are held, at most about DATA_ROWS of them; its queries
    stream past, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, data = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "side")], axis=1)
            cuts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if at != tuple(keys[a, :2]):
                    at, parts, data = tuple(keys[a, :2]), [], None
                piece = batch.slice(a, b - a)
                rows, ids, x = piece.column("row").to_numpy(), piece.column("vec_id").to_numpy(), _matrix(piece.column("v"), width)
                if keys[a, 2] == 0:
                    parts.append((rows, ids, x))
                elif parts:
                    data = data or tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                    for m in range(0, len(rows), QUERY_ROWS):
                        yield _best(rows[m : m + QUERY_ROWS], x[m : m + QUERY_ROWS], data, k)

    n = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "part", "side", "vec_id", "row"]
    return work.repartition(n, "cell", "part").sortWithinPartitions(*order).mapInArrow(tidy(run), "query long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, n_pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every query, ties to smaller vec_id.

    vectors has vec_id and embedding; other columns are ignored. Vectors that are null or empty,
    or hold a null or a component that isn't finite, take no part, and so do rows of null vec_id;
    all others must have the same length. A query with fewer than k other rows gets all of them.
    Rows that repeat a vec_id are rows of their own: each is a candidate for the other, and each
    query among them has its own k rows in the result. An empty table gives an empty result.

    Data are grouped by their nearest pivot. Summaries of the cells (one row a pivot: size,
    greatest distance) come to the driver and give each query the cells it needs. Queries, which
    are few, go to these cells; each vector is dealt once, to one part of bounded size of its
    cell. The best of each part are merged by Spark, a partial best of k at a time.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"), is_query.alias("is_query")).where("v IS NOT NULL AND vec_id IS NOT NULL")
    # stored with a number of each row, as ids may repeat
    clean = stored(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda s, v: s + v.cast("double") * v)).alias("norm")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    if facts["low"] != facts["high"]:
        raise ValueError("vectors differ in length")
    if facts["norm"] >= 2**52:
        raise ValueError("scores must stay below 2**52")
    width = facts["low"]
    known = references(clean, facts["n"])
    pivots = known[1][: n_pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, int(facts["n"] ** 0.5 / 4)))]
    data = stored(in_cells(clean, pivots), "cells")
    # a row for each pivot
    summary = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("far")).orderBy("cell").collect()
    cells, size, far = (np.array([r[c] for r in summary]) for c in ("cell", "n", "far"))
    parts = F.create_map(*[F.lit(int(x)).cast("long") for c, n in zip(cells, size, strict=True) for x in (c, -(-n // DATA_ROWS))])
    n_parts = F.try_element_at(parts, F.col("cell"))

    wanted = needed_cells(clean.where("is_query"), pivots, cells, far, known, k)
    left = wanted.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"), F.lit(1).alias("side"), "row", "vec_id", "v")
    right = data.select("cell", F.pmod(F.xxhash64("row"), n_parts).alias("part"), F.lit(0).alias("side"), "row", "vec_id", "v")
    found = local_top(right.unionAll(left), width, k)
    # a query's best of all parts: k for each part that it met
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id", "row"))), 1, k).alias("best"))
    named = best.join(clean.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    rows = named.select("query_id", F.posexplode("best").alias("rank", "b"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""

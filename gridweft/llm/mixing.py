"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft.llm.common import table

#: Shares of the mixture in the registered query; other sources get DEFAULT_WEIGHT.
WEIGHTS = {"src0": 8, "src1": 4, "src2": 4, "src3": 1}
DEFAULT_WEIGHT = 2
BLOCK_DOCS = 8
#: Bounds of what the driver schedules and broadcasts: sources, and slots of one period.
MAX_SOURCES = 10_000
MAX_PERIOD = 1_000_000
#: Rows of a bucket that are ranked together, until there are 16**MAX_DIGITS buckets.
BUCKET_ROWS = 250
MAX_DIGITS = 5


def pfair_period(weights: Sequence[int]) -> list[list[int]]:
    """Slots that each source holds in one period of sum(weights) slots.

    Block j of a source with share w = weight / sum is released at floor(j / w) and due at
    ceil((j + 1) / w). In each slot the released block with the earliest deadline runs, ties
    to the first source. As shares sum to 1 no deadline is missed, so that after any number of
    slots each source has had its share within less than one block.
    """
    period = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, i) for i, w in enumerate(weights) if w]
    ready: list[tuple[int, int]] = []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * period // weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(t)
        heapq.heappush(waiting, (len(slots[i]) * period // weights[i], i))
    return slots


def mix(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block_docs: int = BLOCK_DOCS, seed: str = "mix") -> DataFrame:
    """doc_id, source, block, slot and position of every row.

    Each source's rows, in a fixed random order (md5 of seed and doc_id), form blocks of
    ``block_docs``; the schedule gives each block its slot, and the mixture is the rows by
    (slot, position). No row is dropped: when a source has run out, its slots stay empty and the
    others go on in proportion. Ranks within a source are the rows of its earlier buckets (one
    number for each source and bucket) plus the rank within the bucket; buckets are ranges of the
    random order, so that the size of a source never decides the size of a task.

    Rows of null source are a source of their own; sources without a weight get ``default``.
    Weights are positive integers. Rows that repeat a doc_id within a source follow each other.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    if any(w < 1 for w in weights.values()) or default < 1:
        raise ValueError("weights must be positive integers")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"))
    digits = 1
    total = docs.count()
    while digits < MAX_DIGITS and 16**digits * BUCKET_ROWS < total:
        digits += 1
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))

    sizes = keyed.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sources = [r["source"] for r in sizes.select("source").distinct().limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources.sort(key=lambda s: (s is not None, s or ""))
    shares = [weights.get(s, default) if s is not None else default for s in sources]
    if sum(shares) > MAX_PERIOD:
        raise ValueError(f"weights sum to more than {MAX_PERIOD}")
    plan = spark.createDataFrame(
        [(s, w, k, t) for s, w, slots in zip(sources, shares, pfair_period(shares), strict=True) for k, t in enumerate(slots)],
        "source string, weight long, turn long, at long",
    )

    # one row for each source and bucket: 16**MAX_DIGITS of a source at most
    before = sizes.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = Window.partitionBy("bucket", "source").orderBy("key", "doc_id")
    ranked = keyed.repartition(parts, "bucket").withColumn("rank", F.row_number().over(within))
    placed = ranked.join(before.withColumnRenamed("source", "of").withColumnRenamed("bucket", "part"), F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("part")))
    index = F.col("before") + F.col("rank") - 1
    blocks = placed.select("doc_id", "source", F.expr("before + rank - 1").alias("index")).select(
        "doc_id", "source", F.floor(F.col("index") / block_docs).alias("block"), F.pmod("index", F.lit(block_docs)).cast("int").alias("position")
    )
    # at most MAX_SOURCES and MAX_PERIOD rows
    share = F.broadcast(spark.createDataFrame(list(zip(sources, shares, strict=True)), "of string, weight long"))
    turns = F.broadcast(plan.select(F.col("source").alias("turn_of"), "turn", "at"))
    timed = blocks.join(share, F.col("source").eqNullSafe(F.col("of"))).withColumn("turn_no", F.col("block") % F.col("weight"))
    out = timed.join(turns, F.col("source").eqNullSafe(F.col("turn_of")) & (F.col("turn_no") == F.col("turn")))
    slot = (F.floor(F.col("block") / F.col("weight")) * sum(shares) + F.col("at")).cast("long")
    return out.select("doc_id", "source", "block", slot.alias("slot"), "position")


def placed(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All documents with their columns and their place in the mixture: mix_slot, mix_position.

    Rows that repeat a doc_id within a source share the first of their places.
    """
    place = F.min(F.struct(F.col("slot").alias("mix_slot"), F.col("position").alias("mix_position"))).alias("place")
    plan = mix(docs, weights, default, block_docs).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source")).agg(place)
    both = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")), "left")
    return both.select(*[both[c] for c in docs.columns], "place.mix_slot", "place.mix_position")


def mixed(docs: DataFrame, weights: Mapping[str, int], default: int = 1, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All documents with their columns, partitioned and sorted in the order of the mixture."""
    both = placed(docs, weights, default, block_docs)
    return both.repartitionByRange("mix_slot", "mix_position").sortWithinPartitions("mix_slot", "mix_position").drop("mix_slot", "mix_position")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, DEFAULT_WEIGHT)


_CASES = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
OP1_SQL = f"""
WITH RECURSIVE src AS (
  SELECT source, (CASE source {_CASES} ELSE {DEFAULT_WEIGHT} END)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS FIRST) AS i
  FROM (SELECT DISTINCT source FROM documents)
), total AS (SELECT sum(w)::BIGINT AS a FROM src),
state(t, i, j) AS (
  SELECT -1::BIGINT, i, 0::BIGINT FROM src
  UNION ALL
  SELECT t + 1, i, j + (i = first_value(i) OVER (ORDER BY (floor(j * a / w) > t + 1), ceil((j + 1) * a / w), i))::BIGINT
  FROM state JOIN src USING (i), total WHERE t + 1 < a
), turns AS (
  SELECT n.i, n.t AS cell, n.j - 1 AS turn FROM state n JOIN state p ON n.i = p.i AND n.t = p.t + 1 WHERE n.j > p.j
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS k FROM documents
)
SELECT r.doc_id, r.source, k // {BLOCK_DOCS} AS block, ((k // {BLOCK_DOCS}) // w) * a + cell AS slot, (k % {BLOCK_DOCS})::INT AS position
FROM ranked r JOIN src ON r.source IS NOT DISTINCT FROM src.source JOIN turns ON turns.i = src.i AND turns.turn = (k // {BLOCK_DOCS}) % w, total
"""

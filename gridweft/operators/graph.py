"""Iterative graph operators: frontier loops with anti-joins, on tables in the shared folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tables of rows found so far that are merged into one.
MERGE = 4


def _folder(df: DataFrame) -> str:
    """The shared folder the cluster names; a temporary one only where none is named, as in tests."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridweft-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, so that lineage doesn't grow with the rounds.

    The plan runs once, later reads take only the columns they need, and lost executors lose nothing.
    """
    path = f"{_folder(df)}/gridweft-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Found:
    """Rows of all rounds as a few tables: each round adds one, and MERGE of like age become one.

    No row is written more often than the logarithm of the rounds.
    """

    def __init__(self, first: DataFrame):
        self.tables: list[tuple[int, DataFrame]] = [(0, first)]

    def add(self, rows: DataFrame) -> None:
        self.tables.append((0, rows))
        while len(self.tables) >= MERGE and self.tables[-MERGE][0] == self.tables[-1][0]:
            age, last = self.tables[-1][0], [x for _, x in self.tables[-MERGE:]]
            self.tables[-MERGE:] = [(age + 1, cut(functools.reduce(DataFrame.unionByName, last)))]

    def all(self) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [x for _, x in self.tables])


def ranked(rows: DataFrame, order: list[str], groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rows with their number, from 1, in an order (within their groups), without a task that holds a group.

    Rows are sorted by ranges; a number is that of the rows in earlier ranges (a row for each range
    and group) plus the place within the range.
    """
    groups = groups or []
    spread = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = spread.groupBy("_range", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range", *groups).orderBy(*order))
    # a row for each range and group
    same = functools.reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_range", *groups)])
    joined = spread.withColumn("_place", place).alias("a").join(offsets.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_before") + F.col("_place")).alias(name))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that undirected edges (a, b) reach.

    Minimum labels with pointer jumping; only whether a label changed comes to the driver.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("target"))
        far = labels.select(F.col("node").alias("target"), F.col("component").alias("far"))
        new = cut(step.join(far, "target", "left").select("node", "old", F.least("target", F.coalesce("far", "target")).alias("component")))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, depth): nodes reached from seeds (keys, node), each with its least depth.

    edges has src and dst, and the keys where a walk must stay within them. Each round joins the
    frontier with the edges and drops nodes seen before, so that cycles end; ``max_depth`` is for
    operators that have a bound, otherwise the walk goes on until nothing new is reached.
    """
    keys = keys or []
    shared = [k for k in keys if k in edges.columns]
    frontier = cut(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    seen, depth = Found(frontier), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.withColumnRenamed("node", "src").join(edges, ["src", *shared]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.all().select(*keys, "node"), [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def follow(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the end of each chain of links (node, next); next is null at an end."""
    current = cut(links.select("node", F.coalesce("next", "node").alias("root")))
    for _ in range(max_rounds):
        jump = current.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(current.join(jump, "root", "left").select("node", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("root")).alias("moved")))
        current = new.select("node", "root")
        if new.where("moved").isEmpty():
            return current
    raise RuntimeError("a chain of links has a cycle")

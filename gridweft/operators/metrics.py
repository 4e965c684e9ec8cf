"""Transformation complexity: backward cones, normalization, register paths, baselines.

Nodes are node_id, op_kind, op_detail, output, inputs ARRAY, bit_width, approximate; roots are
root_id, root_kind, signal; registers are name, q_signal, d_signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweft.operators.graph import cut, reach

MAX_DEPTH = 256


def driver_edges(nodes: DataFrame) -> DataFrame:
    """(signal, node_id, input): each signal's drivers with their inputs.

    A signal without a driver of its own name is driven by the drivers of its slices: an equi-join
    on the base name takes the place of a prefix scan.
    """
    inputs = F.explode_outer("inputs").alias("input")
    exact = nodes.select(F.col("output").alias("signal"), "node_id", inputs)
    base = F.regexp_extract("output", r"^([^\[]*)\[", 1)
    slices = nodes.where(F.col("output").contains("[")).select(base.alias("signal"), "node_id", inputs)
    return exact.unionAll(slices.join(exact.select("signal"), "signal", "left_anti"))


def cones(nodes: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(cone nodes (root_id, root_kind, node_id, depth), signals (root_id, root_kind, signal, depth, driven)).

    From each root through drivers to inputs, all roots in one breadth-first loop; a signal and a
    node count once for each root, at their least depth.
    """
    edges = cut(driver_edges(nodes))
    keys = ["root_id", "root_kind"]
    steps = edges.where("input IS NOT NULL").select(F.col("signal").alias("src"), F.col("input").alias("dst"))
    seen = reach(steps, roots.select(*keys, F.col("signal").alias("node")), max_depth, keys).withColumnRenamed("node", "signal")
    drivers = edges.groupBy("signal").agg(F.collect_set("node_id").alias("nodes"))
    signals = cut(seen.join(drivers, "signal", "left").select(*keys, "signal", "depth", F.col("nodes").isNotNull().alias("driven"), "nodes"))
    found = signals.where("driven").select(*keys, F.explode("nodes").alias("node_id"), "depth")
    return cut(found.groupBy(*keys, "node_id").agg(F.min("depth").alias("depth"))), signals.drop("nodes")


def signature(df: DataFrame) -> DataFrame:
    return df.withColumn("signature", F.concat_ws(":", "op_kind", F.coalesce("op_detail", F.lit("")), F.col("bit_width").cast("string"), F.size("inputs").cast("string")))


def cone_summary(cone: DataFrame, signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per root: nodes, distinct signatures, sources (undriven signals), approximate nodes, depth."""
    keys = ["root_id", "root_kind"]
    rows = cone.join(signature(nodes).select("node_id", "signature", "approximate"), "node_id")
    a = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("signature").alias("unique_ops"), F.count_if("approximate").alias("n_approximate"))
    b = signals.groupBy(*keys).agg(F.count_if(~F.col("driven")).alias("n_sources"), F.max("depth").alias("depth"))
    return b.join(a, keys, "left").na.fill(0, ["raw", "unique_ops", "n_approximate"])


def normalize(cone: DataFrame, nodes: DataFrame, min_width: int = 2) -> tuple[DataFrame, DataFrame]:
    """(counts per root, groups): repeated lanes count once.

    Pass 1 folds nodes of equal signature, two or more, all at least min_width wide; pass 2 folds
    slices left over by width and number of inputs.
    """
    keys = ["root_id", "root_kind"]
    rows = cone.join(signature(nodes).select("node_id", "signature", "op_kind", "bit_width", F.size("inputs").alias("arity")), "node_id")
    lanes = rows.groupBy(*keys, "signature").agg(F.count(F.lit(1)).alias("multiplicity"), F.min("bit_width").alias("least"), F.min_by("bit_width", "node_id").alias("width")).withColumn("lane", (F.col("multiplicity") >= 2) & (F.col("least") >= min_width))
    rest = rows.join(lanes.where("NOT lane").select(*keys, "signature"), [*keys, "signature"], "left_semi")
    stride = (F.col("op_kind") == "Slice") & (F.col("bit_width") >= min_width)
    strides = rest.where(stride).groupBy(*keys, "bit_width", "arity").agg(F.count(F.lit(1)).alias("multiplicity"))
    plain = rest.where(~stride).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = lanes.where("lane").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).unionByName(strides.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))).unionByName(plain)
    counts = parts.groupBy(*keys).agg(F.sum("n").alias("norm"))
    groups = lanes.where("lane").select(*keys, "signature", "multiplicity", "width").unionByName(strides.where("multiplicity >= 2").select(*keys, F.concat_ws(":", F.lit("stride"), F.col("bit_width").cast("string"), F.col("arity").cast("string")).alias("signature"), "multiplicity", F.col("bit_width").alias("width")))
    return counts, groups.orderBy(*keys, "signature", "width", "multiplicity")


def merged_groups(groups: DataFrame) -> DataFrame:
    """Groups over all roots: multiplicities add up, the first width that isn't zero stays."""
    return groups.groupBy("signature").agg(F.sum("multiplicity").alias("multiplicity"), F.min_by(F.when(F.col("width") > 0, F.col("width")), F.struct("root_kind", "root_id")).alias("width"))


def ff_paths(cone: DataFrame, nodes: DataFrame, registers: DataFrame) -> DataFrame:
    """(source, dest): registers whose output is an input of a node in another register's cone."""
    inputs = nodes.select("node_id", F.explode("inputs").alias("q_signal"))
    at = cone.where("root_kind = 'ff_d'").join(inputs, "node_id").join(registers.select(F.col("name").alias("source"), "q_signal"), "q_signal")
    dest = registers.select(F.col("name").alias("dest"), F.col("name").alias("root_id"))
    return at.join(dest, "root_id").where("source <> dest").select("source", "dest").distinct().orderBy("source", "dest")


def best_registers(registers: DataFrame) -> DataFrame:
    """One row for each name: one whose D is no constant if there is any, else the first."""
    w = Window.partitionBy("name").orderBy("d_const", "seq")
    return registers.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def root_list(ports: DataFrame, registers: DataFrame, which: str = "all") -> DataFrame:
    outputs = ports.where("is_top AND direction IN ('Out', 'InOut')").select(F.col("port_name").alias("root_id"), F.lit("output").alias("root_kind"), F.col("port_name").alias("signal"))
    ffd = registers.select(F.col("name").alias("root_id"), F.lit("ff_d").alias("root_kind"), F.col("d_signal").alias("signal"))
    both = outputs.unionByName(ffd)
    return both if which == "all" else both.where(F.col("root_kind") == ("output" if which == "outputs" else "ff_d"))


def unroll(loops: DataFrame, limit: int = 1024) -> DataFrame:
    """A row for each pass of a loop (start, stop); over the limit one approximate pass."""
    n = F.abs(F.col("stop") - F.col("start"))
    return loops.select("*", F.explode(F.sequence(F.lit(1), F.when(n > limit, 1).otherwise(F.greatest(n, F.lit(1))))).alias("pass"), (n > limit).alias("approximate")).where(n > 0)


def top_roots(summary: DataFrame, k: int) -> DataFrame:
    """The k roots of most nodes for display (all for k = 0), by kind and id."""
    rows = summary.orderBy(F.desc("raw"), "root_kind", "root_id").limit(k) if k else summary
    return rows.orderBy("root_kind", "root_id")


def totals(summary: DataFrame) -> DataFrame:
    at = lambda kind: F.coalesce(F.max(F.when(F.col("root_kind") == kind, F.col("raw"))), F.lit(0))
    return summary.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("norm"), F.lit(0)).alias("norm"), at("output").alias("max_output"), at("ff_d").alias("max_ff_d"))


def unsupported_events(events: DataFrame) -> DataFrame:
    """(kind, n, samples): events per kind with the first three details that aren't empty.

    Each partition's first three are kept before any are gathered, so that no list grows.
    """
    w = Window.partitionBy("kind").orderBy("seq")
    first = events.where("detail <> ''").withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("k", "detail"))).alias("s")).select("kind", F.transform("s", lambda x: x["detail"]).alias("samples"))
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(first, "kind", "left")


def diff_metrics(base: DataFrame, current: DataFrame) -> DataFrame:
    """(root_kind, root_id, change, d_raw, d_depth, d_norm) against a baseline; new roots are no regressions."""
    b = base.select("root_kind", "root_id", *[F.col(c).alias(f"b_{c}") for c in ("raw", "depth", "norm")])
    rows = current.select("root_kind", "root_id", "raw", "depth", "norm").join(b, ["root_kind", "root_id"], "full_outer")
    change = F.when(F.col("b_raw").isNull(), "new").when(F.col("raw").isNull(), "removed").when(F.col("raw") > F.col("b_raw"), "regression").when(F.col("raw") < F.col("b_raw"), "improvement").otherwise("same")
    return rows.select("root_kind", "root_id", change.alias("change"), *[(F.coalesce(c, F.lit(0)) - F.coalesce(f"b_{c}", F.lit(0))).alias(f"d_{c}") for c in ("raw", "depth", "norm")])


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("regression", "improvement", "new", "removed")], F.coalesce(F.sum("d_raw"), F.lit(0)).alias("d_raw"))

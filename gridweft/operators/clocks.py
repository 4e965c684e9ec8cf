"""Where clocks come from, and how registers reach each other through names and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators.connect import small
from gridweft.operators.graph import Found, cut

SOURCE = ["source_id", "name", "type", "origin_signal", "master_id", "divide_by"]


def _sources(rows: DataFrame, path: str, kind: str, master: str | None = None, divide: int = 1) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.concat(F.lit(f"{kind.lower()}_"), F.col(path)).alias("source_id"), F.col(path).alias("name"), F.lit(kind).alias("type"), F.col(path).alias("origin_signal"), (F.col(master) if master else none).alias("master_id"), F.lit(divide).alias("divide_by")).distinct()


def _without_net(rows: DataFrame, nets: DataFrame, path: str) -> DataFrame:
    return rows.join(nets.select(F.col("hier_path").alias(path)).distinct(), path, "left_anti")


def unified_clocks(used: DataFrame, port_map: DataFrame, nets: DataFrame) -> DataFrame:
    """Parent signals of ports that their instance uses as a clock (child_net), where no clock net is known."""
    rows = port_map.join(used.select("child_net").distinct(), "child_net", "left_semi").select("parent_net").distinct()
    return _sources(_without_net(rows, nets, "parent_net"), "parent_net", "AutoDetected")


def sensitivity_clocks(edge_signals: DataFrame, nets: DataFrame) -> DataFrame:
    """Signals of edge lists (scope_path, signal) with a clock's and no reset's name, where no net is known."""
    signal = F.col("signal")
    rows = edge_signals.where(names.is_cdc_clock(signal) & ~names.is_cdc_reset(signal)).select(names.full_path(F.col("scope_path"), signal).alias("path")).distinct()
    return _sources(_without_net(rows, nets, "path"), "path", "AutoDetected")


def pll_clocks(instances: DataFrame, ports: DataFrame) -> DataFrame:
    """Outputs of modules named like clock generators are primary sources."""
    plls = instances.where(names.is_pll(F.col("module"))).select(F.col("path").alias("instance_path"))
    rows = ports.where("direction = 'Out'").join(plls, "instance_path", "left_semi")
    return _sources(rows.select(names.full_path(F.col("instance_path"), F.col("port_name")).alias("path")), "path", "Primary")


def dividers(ffs: DataFrame, used: DataFrame) -> DataFrame:
    """Registers that invert themselves and are used or named as a clock: generated, half the frequency.

    ffs has inverted (its input is its own inverse); used has signal, the paths used as clocks.
    """
    rows = ffs.where("inverted").join(used.select(F.col("signal").alias("hier_path"), F.lit(True).alias("used")).distinct(), "hier_path", "left")
    rows = rows.where(F.coalesce("used", F.lit(False)) | names.is_cdc_clock(F.col("hier_path")))
    return _sources(rows.select("hier_path", "source_id"), "hier_path", "Generated", "source_id", 2)


def mark_gated(nets: DataFrame, instances: DataFrame, pins: DataFrame, sources: DataFrame) -> DataFrame:
    """Clock nets (hier_path, source_id, is_gated, gate_enable) with those behind cells named like clock gates.

    pins has instance_path, port_name, parent_path and actual, the signal at each pin. A gate's
    output is bound to a pin named clk...out, q, gclk, clk_out or eclk, its enable to one with en in
    its name; of several the last by name counts. Nets one of whose path's names is the output's
    signal are gated and get the enable; the output itself becomes a net, of the source that the
    gate's clock input names. Names meet by equality, so that no pair of net and gate is made.
    """
    cells = instances.where(names.is_clock_gate(F.col("module"))).select(F.col("path").alias("instance_path"))
    port = F.lower("port_name")
    named = port.contains("clk") | port.contains("ck")
    out = (named & port.contains("out")) | port.isin(*names.GATE_OUTPUTS)
    clock = named & ~port.contains("out") & ~port.isin(*names.GATE_OUTPUTS)
    last = lambda when: F.max_by("actual", F.when(when, F.col("port_name")))
    found = pins.where("actual IS NOT NULL AND actual <> ''").join(cells, "instance_path", "left_semi").groupBy("instance_path", "parent_path").agg(last(out).alias("output"), last(port.contains("en")).alias("enable"), F.min_by("actual", F.when(clock, F.col("port_name"))).alias("input"), F.count_if(out).alias("n_out"))
    gates = cut(found.where("n_out > 0"))
    enables = gates.groupBy(F.col("output").alias("part")).agg(F.max_by("enable", "instance_path").alias("enable"))
    parts = nets.select("hier_path", F.explode(F.array_distinct(F.split("hier_path", r"\."))).alias("part"))
    hit = parts.join(enables, "part").groupBy("hier_path").agg(F.max_by("enable", "part").alias("enable"), F.lit(True).alias("hit"))
    enable = F.when(F.col("hit"), F.col("enable")).otherwise(F.col("gate_enable") if "gate_enable" in nets.columns else F.lit(None).cast("string"))
    marked = nets.join(hit, "hier_path", "left").select("hier_path", "source_id", (F.col("is_gated") | F.coalesce("hit", F.lit(False))).alias("is_gated"), enable.alias("gate_enable"))
    keys = sources.select("source_id", F.explode(F.array_distinct(F.array("name", "origin_signal"))).alias("input")).groupBy("input").agg(F.min("source_id").alias("source_id"))
    new = gates.join(keys, "input", "left").select(names.full_path(F.col("parent_path"), F.col("output")).alias("hier_path"), "source_id", F.lit(True).alias("is_gated"), F.col("enable").alias("gate_enable"))
    return marked.unionByName(new)


def unsafe_clocks(sources: DataFrame, assigns: DataFrame, safe_outputs: DataFrame) -> DataFrame:
    """Sources whose signal is assigned from a multiplexer or an operator, unless constrained, primary or from a safe cell."""
    loose = assigns.where("op IN ('mux', 'binary', 'unary')").select(F.col("lhs").alias("origin_signal")).distinct()
    rows = sources.where("type NOT IN ('Primary', 'Sdc')").join(loose, "origin_signal", "left_semi")
    return rows.join(safe_outputs.select(F.col("signal").alias("origin_signal")), "origin_signal", "left_anti").select("source_id")


def resolve_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(scope_path, signal, path): the known path that a name stands for in its scope.

    In this order: in the scope itself, as a full path, the same without an index, then in the
    enclosing scopes from the nearest. All candidates are equi-joins; the least rank wins.
    """
    rows = wanted.select("scope_path", "signal").distinct()
    bare = F.regexp_replace("signal", r"\[[^\[]*\]$", "")
    parts = F.split("scope_path", r"\.")
    up = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((F.lit(10) + k).alias("rank"), F.concat_ws(".", F.slice(parts, 1, F.size(parts) - k), F.array(bare)).alias("path"))), lambda x: x["path"] != "")
    exact = F.array(*[F.struct(F.lit(r).alias("rank"), p.alias("path")) for r, p in enumerate((names.full_path(F.col("scope_path"), F.col("signal")), F.col("signal"), names.full_path(F.col("scope_path"), bare), bare))])
    options = rows.select("scope_path", "signal", F.explode(F.concat(exact, up)).alias("o"))
    found = options.join(known.select("path").distinct(), F.col("o.path") == F.col("path"), "left_semi")
    return found.groupBy("scope_path", "signal").agg(F.min("o").alias("o")).select("scope_path", "signal", "o.path")


def comb_assigns(assigns: DataFrame) -> DataFrame:
    """Of several drivers of a signal a continuous assignment wins over a block; the first of its kind stays."""
    rank = F.when(F.col("kind") == "assign", 0).otherwise(1)
    return assigns.groupBy("lhs").agg(F.min_by("rhs", F.struct(rank, "seq")).alias("rhs"), F.min_by("op", F.struct(rank, "seq")).alias("op"))


def register_edges(ffs: DataFrame, assigns: DataFrame) -> DataFrame:
    """(src_path, dst_path, has_comb): registers whose value reaches another one's input.

    Inputs resolve to registers directly, or through any number of assignments (lhs, rhs, op), all
    registers in one loop, which ends as no signal is taken twice for a register; has_comb tells
    that an assignment other than an alias lies between, on the shortest way.
    """
    regs = ffs.select(F.col("hier_path").alias("path"))
    hops = cut(comb_assigns(assigns).select("lhs", F.explode("rhs").alias("next"), (F.col("op") != "alias").alias("logic")))
    signals = regs.unionAll(hops.select(F.col("lhs").alias("path"))).distinct()
    inputs = ffs.select(F.col("hier_path").alias("dst_path"), names.parent_of(F.col("hier_path")).alias("scope_path"), F.explode("fanin").alias("signal"))
    named = resolve_names(inputs, signals)
    frontier = cut(inputs.join(named, ["scope_path", "signal"]).select("dst_path", "path", F.lit(False).alias("has_comb")).distinct())
    seen = Found(frontier)
    while not frontier.isEmpty():
        step = frontier.join(hops, F.col("path") == F.col("lhs")).select("dst_path", F.col("next").alias("path"), (F.col("has_comb") | F.col("logic")).alias("has_comb")).groupBy("dst_path", "path").agg(F.bool_or("has_comb").alias("has_comb"))
        frontier = cut(step.join(seen.all().select("dst_path", "path"), ["dst_path", "path"], "left_anti"))
        seen.add(frontier)
    found = seen.all().join(regs, "path", "left_semi")
    return found.groupBy(F.col("path").alias("src_path"), "dst_path").agg(F.bool_or("has_comb").alias("has_comb"))


def evaluate(found: DataFrame, golden: DataFrame) -> DataFrame:
    """(recall, precision) of found domain pairs against known ones; names match when one contains the other."""
    g = golden.select(F.col("source").alias("gs"), F.col("dest").alias("gd")).distinct()
    f = found.select(F.col("source_domain").alias("fs"), F.col("dest_domain").alias("fd")).distinct()
    hit = f.join(small(g), F.col("fs").contains(F.col("gs")) & F.col("fd").contains(F.col("gd")))
    n = hit.agg(F.countDistinct("gs", "gd").alias("g"), F.countDistinct("fs", "fd").alias("f"))
    return n.select(F.try_divide("g", F.lit(g.count())).alias("recall"), F.try_divide("f", F.lit(f.count())).alias("precision"))

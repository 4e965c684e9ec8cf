"""From facts of modules to facts of a design: every instance gets its module's facts under its own path.

Takes the statements of ``sources.rtl``. Hierarchies are built level by level with joins on the module's
name; the rest are equi-joins of instances with statements, so that a module used often is only stored once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators import cdc, clocks, connect
from gridweft.operators.graph import Found, cut, follow

MAX_LEVELS = 64


def instance_tree(statements: DataFrame, top: str, max_depth: int = -1) -> DataFrame:
    """(path, name, parent_path, module, depth, seq) of top and all that stands below it."""
    below = cut(statements.where("kind = 'instance'").select(F.col("module").alias("parent_module"), F.col("name").alias("child"), F.col("target").alias("child_module"), F.col("seq").alias("n")))
    none = F.lit(None).cast("string")
    first = statements.where((F.col("kind") == "module") & (F.col("name") == top)).limit(1)
    frontier = cut(first.select(F.col("name").alias("path"), "name", none.alias("parent_path"), F.col("name").alias("module"), F.lit(0).alias("depth"), F.lit(0).alias("seq")))
    found = Found(frontier)
    for depth in range(1, (MAX_LEVELS if max_depth < 0 else max_depth) + 1):
        step = frontier.join(below, F.col("module") == F.col("parent_module"))
        frontier = cut(step.select(F.concat_ws(".", "path", "child").alias("path"), F.col("child").alias("name"), F.col("path").alias("parent_path"), F.col("child_module").alias("module"), F.lit(depth).alias("depth"), F.col("n").alias("seq")))
        if frontier.isEmpty():
            return cut(found.all())
        found.add(frontier)
    if max_depth < 0:
        raise ValueError(f"the hierarchy is deeper than {MAX_LEVELS} levels; a module may hold itself")
    return cut(found.all())


def _of(statements: DataFrame, kind: str, instances: DataFrame) -> DataFrame:
    """Statements of a kind for each instance of their module, with the instance's path."""
    rows = statements.where(F.col("kind") == kind).drop("kind", "file")
    return rows.join(instances.select("path", "module", F.col("depth")), "module")


def ports(statements: DataFrame, instances: DataFrame) -> DataFrame:
    full = names.full_path(F.col("path"), F.col("name"))
    return _of(statements, "port", instances).select(F.col("path").alias("instance_path"), F.col("name").alias("port_name"), "direction", "width", "is_signed", (F.col("depth") == 0).alias("is_top"), full.alias("full_path"), "seq")


def _bound(statements: DataFrame, instances: DataFrame, found: DataFrame) -> DataFrame:
    """Bindings with the port of the child, found by name or by its place among the module's ports."""
    from pyspark.sql import Window

    rows = _of(statements, "binding", instances).select(names.full_path(F.col("path"), F.col("name")).alias("instance_path"), F.col("path").alias("parent"), F.col("target").alias("port_key"), "refs", "op", "seq")
    place = F.concat(F.lit("#"), (F.row_number().over(Window.partitionBy("instance_path").orderBy("seq")) - 1).cast("string"))
    known = found.select("instance_path", "port_name", "direction", "full_path", place.alias("place"))
    keyed = known.select("instance_path", "port_name", "direction", "full_path", F.explode(F.array("port_name", "place")).alias("port_key"))
    listed = rows.join(keyed, ["instance_path", "port_key"])
    # .* binds what isn't listed to the net of its own name
    rest = rows.where("op = 'wildcard'").drop("refs", "op").join(known.drop("place"), "instance_path").join(listed.select("full_path"), "full_path", "left_anti")
    return listed.unionByName(rest.select("*", F.array("port_name").alias("refs"), F.lit("alias").alias("op")))


def port_bindings(statements: DataFrame, instances: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each net that a port drives or loads; an InOut port does both."""
    rows = _bound(statements, instances, found).select("instance_path", "port_name", "direction", F.explode("refs").alias("net"), "parent", F.when(F.col("op") == "alias", "Direct").otherwise("Approximate").alias("kind"), "seq")
    rows = connect.expand_inout(rows)
    return rows.select("instance_path", "port_name", names.full_path(F.col("parent"), F.col("net")).alias("net_key"), "is_driver", "kind", "seq")


def port_state(statements: DataFrame, instances: DataFrame, found: DataFrame) -> DataFrame:
    """Whether something other than a constant or nothing, a constant, or zero is bound to a port."""
    constant = F.col("op").isin("constant", "zero")
    return _bound(statements, instances, found).select("full_path", (F.col("op") != "open").alias("connected"), constant.alias("tie_off"), (F.col("op") == "zero").alias("tie_zero"))


def assigns(statements: DataFrame, instances: DataFrame) -> DataFrame:
    """(lhs, rhs, op, kind, seq) with full paths."""
    rhs = F.transform("refs", lambda x: names.full_path(F.col("path"), x))
    kind = F.when(F.col("direction") == "assign", "assign").otherwise("comb")
    return _of(statements, "assign", instances).select(names.full_path(F.col("path"), F.col("name")).alias("lhs"), rhs.alias("rhs"), "op", kind.alias("kind"), "seq")


def net_aliases(assigned: DataFrame) -> DataFrame:
    """Assignments of one net to another; those in a block are approximate."""
    rows = assigned.where("op = 'alias' AND size(rhs) = 1")
    return rows.select(F.col("lhs").alias("lhs_key"), F.col("rhs")[0].alias("rhs_key"), (F.col("kind") != "assign").alias("approximate"), "seq")


def registers(statements: DataFrame, instances: DataFrame) -> DataFrame:
    """Registers with their clock's name and net; their source is found by ``clock_domains``."""
    scope = F.col("path")
    return _of(statements, "register", instances).select(names.full_path(scope, F.col("name")).alias("hier_path"), F.coalesce("edge", F.lit("pos")).alias("edge"), F.coalesce("width", F.lit(1)).alias("width"), F.col("refs").alias("fanin"), F.when(F.col("reset").isNotNull(), names.full_path(scope, F.col("reset"))).alias("reset_path"), F.col("reset").isNotNull().alias("reset_async"), "clock", names.full_path(scope, F.col("clock")).alias("clock_net"), F.col("module").alias("primitive"), "seq")


def port_map(statements: DataFrame, instances: DataFrame, found: DataFrame) -> DataFrame:
    """(parent_net, child_net, direction) of ports that one net is bound to."""
    rows = _bound(statements, instances, found).where("op = 'alias'")
    return rows.select(names.full_path(F.col("parent"), F.regexp_replace(F.col("refs")[0], r"\[[^\[\].]*\]$", "")).alias("parent_net"), F.col("full_path").alias("child_net"), "direction")


def clock_domains(ffs: DataFrame, sources: DataFrame, nets: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registers with their source, all sources): a clock that nothing defines is a source of its own.

    It is the net at the upper end of the ports that lead to the register's scope.
    """
    found = cut(cdc.register_domains(ffs, sources, nets))
    up = follow(pins.where("direction <> 'Out'").groupBy(F.col("child_net").alias("node")).agg(F.min("parent_net").alias("next")).unionByName(pins.select(F.col("parent_net").alias("node")).distinct().join(pins.select(F.col("child_net").alias("node")), "node", "left_anti").select("node", F.lit(None).cast("string").alias("next"))))
    found = found.join(up.select(F.col("node").alias("clock_net"), "root"), "clock_net", "left").withColumn("own", F.coalesce("root", "clock_net"))
    new = found.where("source_id IS NULL").select(F.concat(F.lit("net_"), "own").alias("source_id"), F.col("own").alias("name"), F.lit("AutoDetected").alias("type"), F.col("own").alias("origin_signal"), F.lit(None).cast("string").alias("master_id"), F.lit(None).cast("double").alias("period_ns"), F.lit(1).alias("seq")).distinct()
    return found.withColumn("source_id", F.coalesce("source_id", F.concat(F.lit("net_"), "own"))).drop("clock_net", "root", "own"), sources.unionByName(new, allowMissingColumns=True)


def crossings(statements: DataFrame, top: str, constraints: DataFrame | None = None, stages: int = 2) -> DataFrame:
    """All verified crossings of a design, from its source's facts; constraints are clock sources that are known."""
    tree = instance_tree(statements, top)
    found = cut(ports(statements, tree))
    pins = cut(port_map(statements, tree, found))
    sources = cdc.auto_clocks(found, constraints if constraints is not None else found.limit(0).select(F.col("port_name").alias("origin_signal")))
    if constraints is not None:
        sources = sources.unionByName(constraints, allowMissingColumns=True)
    sources = cut(sources.withColumn("seq", F.lit(0)))
    seeds = sources.select("source_id", F.concat_ws(".", F.lit(top), F.col("origin_signal")).alias("hier_path"))
    nets = cdc.propagate_clocks(seeds, pins.where("direction <> 'Out'"))
    ffs, sources = map(cut, clock_domains(registers(statements, tree), sources, nets, pins))
    through = pins.where("direction <> 'Out'").select(F.col("child_net").alias("lhs"), F.array("parent_net").alias("rhs")).unionAll(pins.where("direction <> 'In'").select(F.col("parent_net").alias("lhs"), F.array("child_net").alias("rhs")))
    hops = assigns(statements, tree).unionByName(through.select("*", F.lit("alias").alias("op"), F.lit("port").alias("kind"), F.lit(0).alias("seq")))
    edges = cut(clocks.register_edges(ffs, hops).withColumn("seq", F.lit(0)))
    none = sources.limit(0)
    relations = none.select(F.col("source_id").alias("a_id"), F.col("source_id").alias("b_id"), F.col("name").alias("relationship"), F.lit(True).alias("sdc_declared"), "seq")
    rows = cut(cdc.detect_crossings(edges, ffs, sources, relations, none.select(F.col("name").alias("from_clk"), F.col("name").alias("to_clk")), none.select("source_id")))
    return cdc.verify(rows, ffs, edges, sources, stages)

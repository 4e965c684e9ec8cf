"""Connectivity: links from bindings, filters, checks, waivers, diffs, traces and aggregates.

A connection is a row of source_instance, source_port, source_path, source_width, source_signed,
dest_instance, dest_port, dest_path, dest_width, dest_signed and kind ('Direct' or 'Approximate').
A port is instance_path, port_name, direction, width, is_signed, is_top and full_path. Issues share
the columns of ``ISSUE``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators.graph import Found, components, cut

ISSUE = ["type", "severity", "instance", "port", "source", "dest", "detail"]
#: Weights of errors and warnings in an instance's health (fixed values).
ERROR_WEIGHT, WARN_WEIGHT = 0.15, 0.05
BROADCAST_ROWS = 10_000


def small(rules: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A rule table marked for broadcast if it is small; else Spark chooses."""
    return F.broadcast(rules) if rules.limit(rows + 1).count() <= rows else rules


# --- extraction ----------------------------------------------------------------------------


def canonical_nets(bindings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(net_key, canon, net_approximate): nets joined by aliases get one name."""
    roots = components(aliases.select(F.col("lhs_key").alias("a"), F.col("rhs_key").alias("b")))
    loose = aliases.join(roots, F.col("lhs_key") == F.col("node")).groupBy("component").agg(F.bool_or("approximate").alias("net_approximate"))
    named = roots.join(loose, "component").select(F.col("node").alias("net_key"), F.col("component").alias("canon"), "net_approximate")
    return bindings.select("net_key").distinct().join(named, "net_key", "left").select("net_key", F.coalesce("canon", "net_key").alias("canon"), F.coalesce("net_approximate", F.lit(False)).alias("net_approximate"))


def build_connections(ports: DataFrame, bindings: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every driver of a net to every load of it; approximate if either end or the net is."""
    if aliases is None:
        nets = bindings.withColumn("canon", F.col("net_key")).withColumn("net_approximate", F.lit(False))
    else:
        nets = bindings.join(canonical_nets(bindings, aliases), "net_key")
    bound = nets.join(ports, ["instance_path", "port_name"])

    def end(side: str, driver: bool) -> DataFrame:
        rows = bound.where(F.col("is_driver") == driver)
        return rows.select("canon", "net_approximate", F.col("kind").alias(f"{side}_kind"), F.col("instance_path").alias(f"{side}_instance"), F.col("port_name").alias(f"{side}_port"), names.full_path(F.col("instance_path"), F.col("port_name")).alias(f"{side}_path"), F.col("width").alias(f"{side}_width"), F.col("is_signed").alias(f"{side}_signed"))

    both = end("source", True).join(end("dest", False).drop("net_approximate"), "canon").where("source_path <> dest_path")
    loose = F.col("net_approximate") | (F.col("source_kind") == "Approximate") | (F.col("dest_kind") == "Approximate")
    return both.withColumn("kind", F.when(loose, "Approximate").otherwise("Direct")).drop("net_approximate", "source_kind", "dest_kind", "canon")


def expand_inout(bindings: DataFrame) -> DataFrame:
    """Bindings with a direction as drivers, loads, or both for InOut."""
    roles = F.when(F.col("direction") == "Out", F.array(F.lit(True))).when(F.col("direction") == "In", F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))
    return bindings.withColumn("is_driver", F.explode(roles))


def interface_directions(members: DataFrame) -> DataFrame:
    """Direction of an interface port from its members: only outputs Out, only inputs In, else InOut."""
    seen = members.groupBy("instance_path", "port_name").agg(F.bool_or(F.col("member_direction") == "Out").alias("o"), F.bool_or(F.col("member_direction") == "In").alias("i"), F.bool_or(F.col("member_direction") == "InOut").alias("io"))
    return seen.select("instance_path", "port_name", F.when(F.col("io") | (F.col("o") & F.col("i")), "InOut").when(F.col("o"), "Out").when(F.col("i"), "In").otherwise("InOut").alias("direction"))


def limit_depth(instances: DataFrame, depth: int) -> DataFrame:
    return instances if depth < 0 else instances.where(F.col("depth") <= depth)


# --- filters -------------------------------------------------------------------------------


def drop_ports(connections: DataFrame, ports: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(connections, ports) without the full paths in dropped and the links that touch them."""
    gone = dropped.select("full_path").distinct()
    kept = connections.join(gone, F.col("source_path") == F.col("full_path"), "left_anti").join(gone, F.col("dest_path") == F.col("full_path"), "left_anti")
    return kept, ports.join(gone, "full_path", "left_anti")


def no_connect_ports(ports: DataFrame) -> DataFrame:
    return ports.where(names.is_no_connect(F.col("port_name")))


def tied_ports(state: DataFrame) -> DataFrame:
    return state.where("tie_off").select("full_path")


# --- checks --------------------------------------------------------------------------------


def _link_issue(rows: DataFrame, kind: str, severity: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("type"), severity.alias("severity"), F.col("dest_instance").alias("instance"), F.col("dest_port").alias("port"), F.col("source_path").alias("source"), F.col("dest_path").alias("dest"), detail.alias("detail"))


def _port_issue(rows: DataFrame, kind: str, severity: str, detail: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("instance_path").alias("instance"), F.col("port_name").alias("port"), none.alias("source"), none.alias("dest"), detail.alias("detail"))


def check_width(connections: DataFrame) -> DataFrame:
    """Direct links of unequal width: truncation ERROR, extension of signed to signed INFO, else WARN."""
    rows = connections.where("kind = 'Direct' AND source_width <> dest_width")
    severity = F.when(F.col("source_width") > F.col("dest_width"), "ERROR").when(F.col("source_signed") & F.col("dest_signed"), "INFO").otherwise("WARN")
    return _link_issue(rows, "WIDTH_MISMATCH", severity, F.format_string("%d -> %d bits", "source_width", "dest_width"))


def check_type(connections: DataFrame) -> DataFrame:
    rows = connections.where("kind = 'Direct' AND source_signed <> dest_signed")
    return _link_issue(rows, "TYPE_MISMATCH", F.lit("ERROR"), F.concat(F.when(F.col("source_signed"), "signed").otherwise("unsigned"), F.lit(" -> "), F.when(F.col("dest_signed"), "signed").otherwise("unsigned")))


def check_dangling(ports: DataFrame, connections: DataFrame, connected: DataFrame) -> DataFrame:
    """Outputs below top that drive no link and aren't connected otherwise."""
    rows = ports.where("direction IN ('Out', 'InOut') AND NOT is_top")
    rows = rows.join(connections.select(F.col("source_path").alias("full_path")), "full_path", "left_anti").join(connected.select("full_path"), "full_path", "left_anti")
    return _port_issue(rows, "DANGLING_OUTPUT", "WARN", F.lit("output drives nothing"))


def check_undriven(ports: DataFrame, connections: DataFrame, connected: DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """Inputs below top that no link drives and that aren't connected otherwise.

    optional holds full paths of inputs that their instance declares optional.
    """
    rows = ports.where("direction IN ('In', 'InOut') AND NOT is_top")
    rows = rows.join(connections.select(F.col("dest_path").alias("full_path")), "full_path", "left_anti").join(connected.select("full_path"), "full_path", "left_anti")
    if optional is not None:
        rows = rows.join(optional.select("full_path"), "full_path", "left_anti")
    return _port_issue(rows, "UNDRIVEN_INPUT", "ERROR", F.lit("input has no driver"))


# Required signals by protocol and channel (fixed values).
PROTOCOLS = {
    "AXI4": {
        "AW": ("AWVALID", "AWREADY", "AWADDR", "AWLEN", "AWSIZE", "AWBURST"),
        "W": ("WVALID", "WREADY", "WDATA", "WSTRB", "WLAST"),
        "B": ("BVALID", "BREADY", "BRESP"),
        "AR": ("ARVALID", "ARREADY", "ARADDR", "ARLEN", "ARSIZE", "ARBURST"),
        "R": ("RVALID", "RREADY", "RDATA", "RRESP", "RLAST"),
    },
    "AXI4-Lite": {
        "AW": ("AWVALID", "AWREADY", "AWADDR"),
        "W": ("WVALID", "WREADY", "WDATA", "WSTRB"),
        "B": ("BVALID", "BREADY", "BRESP"),
        "AR": ("ARVALID", "ARREADY", "ARADDR"),
        "R": ("RVALID", "RREADY", "RDATA", "RRESP"),
    },
    "AXI-Stream": {"data": ("TVALID", "TREADY", "TDATA")},
    "AHB": {"main": ("HSEL", "HADDR", "HTRANS", "HWRITE", "HSIZE", "HBURST", "HWDATA", "HRDATA", "HREADY", "HRESP")},
    "APB": {"main": ("PSEL", "PENABLE", "PWRITE", "PADDR", "PWDATA", "PRDATA", "PREADY")},
}
#: Signals that identify an interface where they differ from the required ones, and signals that
#: tell its role (fixed values).
KEY_SIGNALS = {"AXI-Stream": ("TVALID", "TREADY", "TDATA", "TLAST", "TKEEP")}
ROLE_SIGNALS = {"AXI4": ("AWVALID", "WVALID", "TVALID"), "AXI4-Lite": ("AWVALID", "WVALID"), "AXI-Stream": ("TVALID",), "AHB": ("HTRANS",), "APB": ("PSEL", "PENABLE", "PWRITE")}
MATCH_RATIO = 0.6


def protocol_table(spark: SparkSession) -> DataFrame:
    """(protocol, channel, signal, position) of all required signals; a constant of about 80 rows."""
    rows = [(p, c, s, k) for p, channels in PROTOCOLS.items() for c, signals in channels.items() for k, s in enumerate(signals)]
    return spark.createDataFrame(rows, "protocol string, channel string, signal string, position int")


def _matched(ports: DataFrame, signals: DataFrame) -> DataFrame:
    """Ports with the signals their names end with: an equi-join on the name's suffixes."""
    parts = F.split(F.upper("port_name"), "_")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    return ports.withColumn("signal", F.explode(tails)).join(F.broadcast(signals), "signal")


def check_protocol(ports: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Channels of a protocol of which an instance has some, but not all required signals."""
    table = protocol_table(ports.sparkSession) if table is None else table
    seen = _matched(ports.where("NOT is_top"), table).select("instance_path", "protocol", "channel", "signal").distinct()
    total = table.groupBy("protocol", "channel").agg(F.collect_set("signal").alias("required"))
    found = seen.groupBy("instance_path", "protocol", "channel").agg(F.collect_set("signal").alias("present")).join(F.broadcast(total), ["protocol", "channel"])
    missing = F.array_sort(F.array_except("required", "present"))
    rows = found.where(F.size("present") < F.size("required")).withColumn("port_name", F.lit(None).cast("string"))
    return _port_issue(rows, "PROTOCOL_INCOMPLETE", "WARN", F.concat(F.col("protocol"), F.lit(" "), F.col("channel"), F.lit(" lacks "), F.array_join(missing, ", ")))


def classify_interfaces(ports: DataFrame) -> DataFrame:
    """(instance_path, protocol, role, prefix, matched): protocols of which 60 % of key signals are there.

    Where AXI4 and AXI4-Lite both fit, the better ratio stays and ties go to AXI4. The prefix is
    the most frequent one before a matched signal, ties to the smallest; the role follows the
    direction of the first port that matches a role signal.
    """
    spark = ports.sparkSession
    keys = {p: KEY_SIGNALS.get(p) or tuple(s for signals in c.values() for s in signals) for p, c in PROTOCOLS.items()}
    order = list(PROTOCOLS)
    table = spark.createDataFrame([(p, s, len(k), order.index(p), s in ROLE_SIGNALS[p]) for p, k in keys.items() for s in k], "protocol string, signal string, total int, rank int, tells boolean")
    hits = _matched(ports, table)
    prefix = F.expr("left(port_name, length(port_name) - length(signal))")
    role = F.min_by(F.when(F.col("direction") == "Out", "master").when(F.col("direction") == "In", "slave"), "seq")
    groups = hits.groupBy("instance_path", "protocol", "rank", "total").agg(F.countDistinct("signal").alias("n"), F.array_sort(F.collect_set("port_name")).alias("matched"))
    groups = groups.withColumn("ratio", F.col("n") / F.col("total")).where(F.col("ratio") >= MATCH_RATIO)
    axi = Window.partitionBy("instance_path", F.col("protocol").isin("AXI4", "AXI4-Lite")).orderBy(F.desc("ratio"), "rank")
    groups = groups.withColumn("best", F.row_number().over(axi)).where("protocol NOT IN ('AXI4', 'AXI4-Lite') OR best = 1")
    counts = hits.groupBy("instance_path", "protocol", prefix.alias("prefix")).count()
    first = Window.partitionBy("instance_path", "protocol").orderBy(F.desc("count"), "prefix")
    prefixes = counts.withColumn("k", F.row_number().over(first)).where("k = 1").select("instance_path", "protocol", "prefix")
    roles = hits.where("tells AND direction IN ('In', 'Out')").groupBy("instance_path", "protocol").agg(role.alias("role"))
    return groups.join(prefixes, ["instance_path", "protocol"]).join(roles, ["instance_path", "protocol"], "left").select("instance_path", "protocol", F.coalesce("role", F.lit("unknown")).alias("role"), "prefix", "matched")


def check_expected(connections: DataFrame, rules: DataFrame) -> DataFrame:
    """Expected rules (from_pat, to_pat) that no link satisfies."""
    hit = names.glob_match(F.col("source_path"), F.col("from_pat")) & names.glob_match(F.col("dest_path"), F.col("to_pat"))
    used = connections.select("source_path", "dest_path").join(small(rules), hit).select("seq").distinct()
    none = F.lit(None).cast("string")
    return rules.join(used, "seq", "left_anti").select(F.lit("EXPECT_MISSING").alias("type"), F.lit("ERROR").alias("severity"), none.alias("instance"), none.alias("port"), F.col("from_pat").alias("source"), F.col("to_pat").alias("dest"), F.lit("expected link is missing").alias("detail"))


def check_forbidden(connections: DataFrame, rules: DataFrame) -> DataFrame:
    """Links that a forbidden rule names, each with its first rule."""
    hit = names.glob_match(F.col("source_path"), F.col("from_pat")) & names.glob_match(F.col("dest_path"), F.col("to_pat"))
    found = connections.join(small(rules), hit).groupBy("source_path", "dest_path", "dest_instance", "dest_port").agg(F.min_by(F.struct("from_pat", "to_pat"), "seq").alias("rule"))
    return _link_issue(found, "EXPECT_FORBIDDEN", F.lit("ERROR"), F.concat(F.lit("forbidden by "), F.col("rule.from_pat"), F.lit(" -> "), F.col("rule.to_pat")))


def run_checks(parts: list[DataFrame]) -> DataFrame:
    """All issues of the checks that are switched on, in their order (column seq)."""
    out = [p.select(*ISSUE).withColumn("check", F.lit(k)) for k, p in enumerate(parts)]
    both = out[0]
    for p in out[1:]:
        both = both.unionByName(p)
    return both


# --- waivers, status and diff --------------------------------------------------------------


def apply_waivers(issues: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, waived) issues: a rule's pattern fits the port's path or an end of the link, and its type."""
    path = F.coalesce(names.full_path(F.col("instance"), F.col("port")), F.col("source"))
    fits = (F.col("w_type") == "*") | (F.col("w_type") == F.col("type"))
    at = names.glob_match(path, F.col("pattern")) | names.glob_match(F.coalesce("source", F.lit("")), F.col("pattern"))
    broad = small(rules.select("pattern", F.col("type").alias("w_type")))
    return issues.join(broad, fits & at, "left_anti"), issues.join(broad, fits & at, "left_semi")


def connection_status(connections: DataFrame, issues: DataFrame) -> DataFrame:
    """Each link with the type of its first issue, or OK."""
    first = issues.where("source IS NOT NULL").groupBy(F.col("source").alias("source_path"), F.col("dest").alias("dest_path")).agg(F.min_by("type", F.struct("check", "type")).alias("found"))
    return connections.join(first, ["source_path", "dest_path"], "left").select(*connections.columns, F.coalesce("found", F.lit("OK")).alias("status"))


def diff_connections(base: DataFrame, current: DataFrame) -> DataFrame:
    """(change, source, dest, old_status, new_status): added, removed and changed links.

    Each row that was added, removed or changed is reported, repeated ones too; of repeated rows
    on the other side the last (by seq) counts.
    """
    last = lambda df, name: df.groupBy("source", "dest").agg(F.max_by("status", "seq").alias(name))
    now = current.join(last(base, "old_status"), ["source", "dest"], "left")
    final = last(current, "new_status")
    none = F.lit(None).cast("string")
    added = now.where("old_status IS NULL").select(F.lit("added").alias("change"), "source", "dest", none.alias("old_status"), F.col("status").alias("new_status"))
    changed = now.where("old_status IS NOT NULL AND old_status <> status").select(F.lit("changed").alias("change"), "source", "dest", "old_status", F.col("status").alias("new_status"))
    removed = base.join(final, ["source", "dest"], "left_anti").select(F.lit("removed").alias("change"), "source", "dest", F.col("status").alias("old_status"), none.alias("new_status"))
    return added.unionByName(changed).unionByName(removed)


# --- aggregates ----------------------------------------------------------------------------


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARN", "INFO")])


def module_health(ports: DataFrame, connections: DataFrame, issues: DataFrame) -> DataFrame:
    """Ports, connected ports, issues and a score for each instance below top, worst first."""
    used = connections.select(F.col("source_path").alias("full_path")).unionAll(connections.select(F.col("dest_path").alias("full_path"))).distinct().withColumn("used", F.lit(1))
    by_port = ports.where("NOT is_top").join(used, "full_path", "left").groupBy("instance_path").agg(F.count(F.lit(1)).alias("n_ports"), F.count("used").alias("n_connected"))
    by_issue = issues.groupBy(F.col("instance").alias("instance_path")).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("ERROR", "WARN", "INFO")])
    rows = by_port.join(by_issue, "instance_path", "left").na.fill(0, ["n_error", "n_warn", "n_info"])
    score = F.greatest(F.lit(0.0), 1.0 - ERROR_WEIGHT * F.col("n_error") - WARN_WEIGHT * F.col("n_warn"))
    return rows.withColumn("score", score).orderBy("score", "instance_path")


def overall_score(health: DataFrame) -> DataFrame:
    return health.agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("score"))


def coupling(connections: DataFrame) -> DataFrame:
    """Links from instance to instance, most first; links within one instance don't count."""
    pairs = connections.where("source_instance <> dest_instance").groupBy("source_instance", "dest_instance").agg(F.count(F.lit(1)).alias("n_links"))
    return pairs.orderBy(F.desc("n_links"), "source_instance", "dest_instance")


# Level of each issue type apart from width mismatches (fixed values).
RISK = {"TYPE_MISMATCH": "MEDIUM", "PROTOCOL_INCOMPLETE": "HIGH", "UNDRIVEN_INPUT": "MEDIUM", "DANGLING_OUTPUT": "LOW", "CONVENTION": "LOW", "EXPECT_MISSING": "MEDIUM", "EXPECT_FORBIDDEN": "HIGH"}


def risks(issues: DataFrame) -> DataFrame:
    """Issues with their risk: of width mismatches, truncation (ERROR) is HIGH and extension LOW."""
    level = F.when((F.col("type") == "WIDTH_MISMATCH") & (F.col("severity") == "ERROR"), "HIGH").when(F.col("type") == "WIDTH_MISMATCH", "LOW")
    for kind, value in RISK.items():
        level = level.when(F.col("type") == kind, value)
    rank = F.when(F.col("level") == "HIGH", 0).when(F.col("level") == "MEDIUM", 1).otherwise(2)
    return issues.withColumn("level", level).orderBy(rank, "type", "source", "dest", "instance", "port")


def clock_reset_topology(ports: DataFrame, connections: DataFrame) -> DataFrame:
    """(kind, net, instance_path): inputs that are clocks or resets by their own or their driver's name.

    A port that is one by its own name takes its only driver's path as the net if that is one too.
    """
    inputs = ports.where("direction = 'In' AND NOT is_top")
    feeds = connections.select(F.col("dest_path").alias("full_path"), F.col("source_path"), F.col("source_port"))
    up = feeds.groupBy("full_path").agg(F.count(F.lit(1)).alias("n_up"), F.min("source_path").alias("only"), F.min("source_port").alias("only_port"), F.min(F.when(names.is_conn_clock(F.col("source_port")) | names.is_conn_reset(F.col("source_port")), F.struct("source_path", "source_port"))).alias("hit"))
    rows = inputs.join(up, "full_path", "left")
    own_clock, own_reset = names.is_conn_clock(F.col("port_name")), names.is_conn_reset(F.col("port_name"))
    up_clock = names.is_conn_clock(F.col("hit.source_port"))
    kind = F.when(own_clock, "clock").when(own_reset, "reset").when(F.col("hit").isNotNull(), F.when(up_clock, "clock").otherwise("reset"))
    same = F.when(F.col("kind") == "clock", names.is_conn_clock(F.col("only_port"))).otherwise(names.is_conn_reset(F.col("only_port")))
    net = F.when(own_clock | own_reset, F.when((F.col("n_up") == 1) & same, F.col("only")).otherwise(F.col("port_name"))).otherwise(F.col("hit.source_path"))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", net.alias("net"), "instance_path")


def clocks_without_reset(topology: DataFrame) -> DataFrame:
    pick = lambda k: topology.where(F.col("kind") == k).select("instance_path").distinct()
    return pick("clock").exceptAll(pick("reset")).distinct()


# --- traces --------------------------------------------------------------------------------


def trace(connections: DataFrame, pattern: str, direction: str = "out", max_depth: int = 16) -> DataFrame:
    """Links reached from ports that a glob names, each with its depth.

    Depth 0 are links whose near end fits the pattern. A hop goes on through the instance it has
    reached: all links that leave it follow. Every link comes once; cycles end by the anti-join.
    """
    near, far = ("source", "dest") if direction == "out" else ("dest", "source")
    links = cut(connections.select("source_path", "dest_path", "source_instance", "dest_instance").distinct())
    frontier = cut(links.where(names.glob_match(F.col(f"{near}_path"), F.lit(pattern))).withColumn("depth", F.lit(0)))
    seen = Found(frontier)
    keys = ["source_path", "dest_path"]
    for depth in range(1, max_depth + 1):
        at = frontier.select(F.col(f"{far}_instance").alias(f"{near}_instance")).distinct()
        step = links.join(at, f"{near}_instance", "left_semi").join(seen.all(), keys, "left_anti")
        frontier = cut(step.select(*links.columns).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()

"""Queries of the connectivity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators import connect as c
from gridweft.operators.graph import components
from gridweft.plans.facts import LINKS, PORTS, links, order_ports
from gridweft.plans.registry import flagship, query, t

ISSUE_COLS = ["type", "severity", "instance", "port", "source", "dest"]

query(
    "flagship_width_by_nation",
    """SELECT r_name, n_name, CASE WHEN p_size > l_quantity::INT THEN 'ERROR' ELSE 'WARN' END AS severity, count(*) AS n_issues
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE p_size <> l_quantity::INT GROUP BY ALL""",
)(flagship)

WIDTH = """width_issues AS (
  SELECT 'WIDTH_MISMATCH' AS type, CASE WHEN source_width > dest_width THEN 'ERROR' WHEN source_signed AND dest_signed THEN 'INFO' ELSE 'WARN' END AS severity,
         dest_instance AS instance, dest_port AS port, source_path AS source, dest_path AS dest
  FROM links WHERE kind = 'Direct' AND source_width <> dest_width
)"""
TYPE = """type_issues AS (
  SELECT 'TYPE_MISMATCH' AS type, 'ERROR' AS severity, dest_instance AS instance, dest_port AS port, source_path AS source, dest_path AS dest
  FROM links WHERE kind = 'Direct' AND source_signed <> dest_signed
)"""


@query("c1_width", f"WITH {LINKS}, {WIDTH} SELECT * FROM width_issues")
def width(spark, d):
    return c.check_width(links(spark, d)).select(*ISSUE_COLS)


@query("c2_type", f"WITH {LINKS}, {TYPE} SELECT * FROM type_issues")
def types(spark, d):
    return c.check_type(links(spark, d)).select(*ISSUE_COLS)


def _ends(spark, d):
    """Order ports with the connections that lineitems make: net of the order, driver or load by direction."""
    ports = order_ports(spark, d)
    used = t(spark, d, "lineitem").select("l_orderkey").distinct()
    at = ports.join(used, F.col("o_orderkey") == F.col("l_orderkey"))
    conn = at.select(F.col("full_path").alias("source_path"), F.col("full_path").alias("dest_path"))
    return ports, conn


_OPEN = "FROM ports WHERE direction = '{0}' AND NOT is_top AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND full_path NOT LIKE '%7'"


@query("c3_dangling", f"WITH {PORTS} SELECT 'DANGLING_OUTPUT' AS type, 'WARN' AS severity, instance_path AS instance, port_name AS port {_OPEN.format('Out')}")
def dangling(spark, d):
    ports, conn = _ends(spark, d)
    return c.check_dangling(ports, conn, ports.where("full_path LIKE '%7'")).select("type", "severity", "instance", "port")


@query("c4_undriven", f"WITH {PORTS} SELECT 'UNDRIVEN_INPUT' AS type, 'ERROR' AS severity, instance_path AS instance, port_name AS port {_OPEN.format('In')} AND full_path NOT LIKE '%4'")
def undriven(spark, d):
    ports, conn = _ends(spark, d)
    return c.check_undriven(ports, conn, ports.where("full_path LIKE '%7'"), ports.where("full_path LIKE '%4'")).select("type", "severity", "instance", "port")


def _event_ports(spark, d):
    """Each user is an instance with ports named after its events' types as bus signals."""
    e = t(spark, d, "events")
    signal = F.expr("element_at(array('PSEL','PENABLE','PWRITE','PADDR','PWDATA','PRDATA','PREADY','TVALID','TREADY','TDATA'), cast(pmod(event_id * 7 + length(event_type), 10) + 1 as int))")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 400).cast("string")).alias("instance_path"), F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("s_")).otherwise(F.lit("m_")), F.lower(signal)).alias("port_name"), F.lit(False).alias("is_top"), F.when(F.col("event_id") % 3 == 0, "In").otherwise("Out").alias("direction"), F.col("event_id").cast("int").alias("seq"))


_EVENT_PORTS = """sig AS (
  SELECT 'u' || (user_id % 400) AS instance_path, event_id, ['PSEL','PENABLE','PWRITE','PADDR','PWDATA','PRDATA','PREADY','TVALID','TREADY','TDATA'][((event_id * 7 + length(event_type)) % 10 + 1)::INT] AS signal FROM events
), req(protocol, channel, signal) AS (
  SELECT 'APB', 'main', unnest(['PSEL','PENABLE','PWRITE','PADDR','PWDATA','PRDATA','PREADY']) UNION ALL SELECT 'AXI-Stream', 'data', unnest(['TVALID','TREADY','TDATA'])
)"""


@query(
    "c5_protocol",
    f"""WITH {_EVENT_PORTS}, total AS (SELECT protocol, channel, count(*) AS n FROM req GROUP BY ALL),
found AS (SELECT instance_path, protocol, channel, count(DISTINCT signal) AS n, list(DISTINCT signal) AS present FROM sig JOIN req USING (signal) GROUP BY ALL)
SELECT instance_path AS instance, f.protocol || ' ' || f.channel || ' lacks ' || (SELECT string_agg(signal, ', ' ORDER BY signal) FROM req r WHERE r.protocol = f.protocol AND r.channel = f.channel AND NOT list_contains(f.present, r.signal)) AS detail
FROM found f JOIN total USING (protocol, channel) WHERE f.n < total.n""",
)
def protocol(spark, d):
    return c.check_protocol(_event_ports(spark, d)).select("instance", "detail")


@query(
    "a10_interfaces",
    f"""WITH {_EVENT_PORTS}, keys(protocol, signal, total) AS (
  SELECT 'APB', unnest(['PSEL','PENABLE','PWRITE','PADDR','PWDATA','PRDATA','PREADY']), 7 UNION ALL SELECT 'AXI-Stream', unnest(['TVALID','TREADY','TDATA','TLAST','TKEEP']), 5
), hits AS (
  SELECT instance_path, protocol, signal, total, event_id, CASE WHEN event_id % 2 = 0 THEN 's_' ELSE 'm_' END AS prefix, CASE WHEN event_id % 3 = 0 THEN 'slave' ELSE 'master' END AS role FROM sig JOIN keys USING (signal)
), ok AS (SELECT instance_path, protocol FROM hits GROUP BY instance_path, protocol, total HAVING count(DISTINCT signal) / total >= 0.6),
pre AS (SELECT instance_path, protocol, prefix, row_number() OVER (PARTITION BY instance_path, protocol ORDER BY count(*) DESC, prefix) AS k FROM hits GROUP BY instance_path, protocol, prefix),
rol AS (SELECT instance_path, protocol, arg_min(role, event_id) AS role FROM hits WHERE signal IN ('PSEL','PENABLE','PWRITE','TVALID') GROUP BY ALL)
SELECT ok.instance_path, ok.protocol, coalesce(role, 'unknown') AS role, prefix FROM ok JOIN pre ON pre.instance_path = ok.instance_path AND pre.protocol = ok.protocol AND k = 1 LEFT JOIN rol ON rol.instance_path = ok.instance_path AND rol.protocol = ok.protocol""",
)
def interfaces(spark, d):
    return c.classify_interfaces(_event_ports(spark, d)).select("instance_path", "protocol", "role", "prefix")


_RULES = [("expected", "n1.s*", "n2.c*", 0), ("expected", "n9?.s*", "*", 1), ("expected", "n1_.s*", "*", 2), ("forbidden", "n3.s*", "n4.*", 0), ("forbidden", "n3.*", "n?.*", 1)]


def _rules(spark, kind):
    return spark.createDataFrame([r[1:] for r in _RULES if r[0] == kind], "from_pat string, to_pat string, seq int")


@query(
    "c7_expect_missing",
    rf"""WITH {LINKS}, rules(from_pat, to_pat, f, g) AS (VALUES ('n1.s*', 'n2.c*', 'n1.s%', 'n2.c%'), ('n9?.s*', '*', 'n9_.s%', '%'), ('n1_.s*', '*', 'n1\_.s%', '%'))
SELECT from_pat AS source, to_pat AS dest FROM rules WHERE NOT EXISTS (SELECT 1 FROM links WHERE source_path LIKE f ESCAPE '\' AND dest_path LIKE g ESCAPE '\')""",
)
def expect_missing(spark, d):
    return c.check_expected(links(spark, d), _rules(spark, "expected")).select("source", "dest")


@query(
    "c8_expect_forbidden",
    f"""WITH {LINKS} SELECT source_path AS source, dest_path AS dest, 'forbidden by ' || CASE WHEN dest_path LIKE 'n4.%' THEN 'n3.s* -> n4.*' ELSE 'n3.* -> n?.*' END AS detail
FROM links WHERE source_path LIKE 'n3.s%' AND (dest_path LIKE 'n4.%' OR dest_path LIKE 'n_.%') GROUP BY ALL""",
)
def forbidden(spark, d):
    return c.check_forbidden(links(spark, d), _rules(spark, "forbidden")).select("source", "dest", "detail")


def _waivers(spark):
    return spark.createDataFrame([("n1.*", "*", "", "", 0), ("n2?.c*", "WIDTH_MISMATCH", "", "", 1)], "pattern string, type string, reason string, source string, seq int")


_WAIVED = "(coalesce(instance || '.' || port, source) LIKE 'n1.%' OR source LIKE 'n1.%' OR (type = 'WIDTH_MISMATCH' AND (coalesce(instance || '.' || port, source) LIKE 'n2_.c%' OR source LIKE 'n2_.c%')))"


def _issues(spark, d):
    x = links(spark, d)
    return c.run_checks([c.check_width(x), c.check_type(x)])


@query("j10_waivers_active", f"WITH {LINKS}, {WIDTH}, {TYPE}, i AS (SELECT * FROM width_issues UNION ALL SELECT * FROM type_issues) SELECT type, severity, count(*) AS n FROM i WHERE NOT {_WAIVED} GROUP BY ALL")
def waivers_active(spark, d):
    return c.apply_waivers(_issues(spark, d), _waivers(spark))[0].groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("j10_waivers_waived", f"WITH {LINKS}, {WIDTH}, {TYPE}, i AS (SELECT * FROM width_issues UNION ALL SELECT * FROM type_issues) SELECT type, severity, count(*) AS n FROM i WHERE {_WAIVED} GROUP BY ALL")
def waivers_waived(spark, d):
    return c.apply_waivers(_issues(spark, d), _waivers(spark))[1].groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("j4_connection_status", f"WITH {LINKS} SELECT source_path, dest_path, CASE WHEN kind = 'Direct' AND source_width <> dest_width THEN 'WIDTH_MISMATCH' WHEN kind = 'Direct' AND source_signed <> dest_signed THEN 'TYPE_MISMATCH' ELSE 'OK' END AS status FROM links")
def status(spark, d):
    return c.connection_status(links(spark, d), _issues(spark, d)).select("source_path", "dest_path", "status")


def _slice(spark, d, low, high):
    item = t(spark, d, "lineitem")
    return item.where((F.col("l_orderkey") % 10 >= low) & (F.col("l_orderkey") % 10 < high)).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("dest"), F.when(F.lit(low) == 0, F.col("l_returnflag")).otherwise(F.col("l_linestatus")).alias("status"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"))


@query(
    "j6_connection_diff",
    """WITH b AS (SELECT 's' || l_suppkey AS source, 'o' || l_orderkey AS dest, l_returnflag AS status, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem WHERE l_orderkey % 10 < 6),
n AS (SELECT 's' || l_suppkey AS source, 'o' || l_orderkey AS dest, l_linestatus AS status, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem WHERE l_orderkey % 10 >= 4),
bl AS (SELECT source, dest, arg_max(status, seq) AS old FROM b GROUP BY ALL)
SELECT 'added' AS change, source, dest, NULL::VARCHAR AS old_status, status AS new_status FROM n ANTI JOIN bl USING (source, dest)
UNION ALL SELECT 'changed', source, dest, old, status FROM n JOIN bl USING (source, dest) WHERE old <> status
UNION ALL SELECT 'removed', source, dest, status, NULL FROM b ANTI JOIN n USING (source, dest)""",
)
def connection_diff(spark, d):
    return c.diff_connections(_slice(spark, d, 0, 6), _slice(spark, d, 4, 10))


@query("a1_severity_counts", f"WITH {LINKS}, {WIDTH} SELECT count_if(severity = 'ERROR')::BIGINT AS error, count_if(severity = 'WARN')::BIGINT AS warn, count_if(severity = 'INFO')::BIGINT AS info FROM width_issues")
def severity(spark, d):
    return c.severity_counts(c.check_width(links(spark, d)))


def _load_ports(spark, d):
    x = links(spark, d)
    return x.select(F.col("dest_instance").alias("instance_path"), F.col("dest_path").alias("full_path"), F.lit(False).alias("is_top")).distinct()


_HEALTH = f"""WITH {LINKS}, {WIDTH}, p AS (SELECT dest_instance AS instance_path, count(DISTINCT dest_path) AS n_ports FROM links GROUP BY ALL),
i AS (SELECT instance AS instance_path, count_if(severity = 'ERROR') AS n_error, count_if(severity = 'WARN') AS n_warn FROM width_issues GROUP BY ALL)
SELECT instance_path, n_ports, coalesce(n_error, 0)::BIGINT AS n_error, coalesce(n_warn, 0)::BIGINT AS n_warn, round(greatest(0, 1 - 0.15::DOUBLE * coalesce(n_error, 0) - 0.05::DOUBLE * coalesce(n_warn, 0)), 6) AS score FROM p LEFT JOIN i USING (instance_path)"""


def _health(spark, d):
    x = links(spark, d)
    return c.module_health(_load_ports(spark, d), x, c.check_width(x))


@query("a3_module_health", _HEALTH)
def health(spark, d):
    return _health(spark, d).select("instance_path", "n_ports", "n_error", "n_warn", F.round("score", 6).alias("score"))


@query("a4_overall_score", f"SELECT round(avg(score), 6) AS score FROM ({_HEALTH})")
def overall(spark, d):
    return c.overall_score(_health(spark, d)).select(F.round("score", 6).alias("score"))


_COUPLING = f"WITH {LINKS} SELECT source_instance, dest_instance, count(*) AS n_links FROM links WHERE source_instance <> dest_instance GROUP BY ALL"


@query("a5_coupling", _COUPLING)
def coupling(spark, d):
    return c.coupling(links(spark, d))


@query("o4_top_coupling", f"{_COUPLING} ORDER BY n_links DESC, source_instance, dest_instance LIMIT 5")
def top_coupling(spark, d):
    return c.coupling(links(spark, d)).limit(5)


@query("a6_risks", f"WITH {LINKS}, {WIDTH}, {TYPE} SELECT level, type, count(*) AS n FROM (SELECT CASE WHEN type = 'TYPE_MISMATCH' THEN 'MEDIUM' WHEN severity = 'ERROR' THEN 'HIGH' ELSE 'LOW' END AS level, type FROM (SELECT * FROM width_issues UNION ALL SELECT * FROM type_issues)) GROUP BY ALL")
def risk(spark, d):
    return c.risks(_issues(spark, d)).groupBy("level", "type").agg(F.count(F.lit(1)).alias("n"))


_TOPOLOGY = f"""WITH {PORTS}, topo AS (SELECT CASE WHEN port_name LIKE '%clk%' THEN 'clock' ELSE 'reset' END AS kind, port_name AS net, instance_path FROM ports WHERE direction = 'In' AND NOT is_top AND (port_name LIKE '%clk%' OR port_name LIKE '%rst%'))"""


def _topology(spark, d):
    none = spark.createDataFrame([], "source_path string, source_port string, dest_path string")
    return c.clock_reset_topology(order_ports(spark, d), none)


@query("a7_clock_reset_topology", f"{_TOPOLOGY} SELECT kind, net, instance_path FROM topo")
def topology(spark, d):
    return _topology(spark, d)


@query(
    "j24_upstream_names",
    f"""WITH {PORTS}, i AS (SELECT *, o_orderkey % 4 AS f FROM ports WHERE direction = 'In' AND NOT is_top AND NOT (port_name LIKE '%clk%' OR port_name LIKE '%rst%'))
SELECT CASE f WHEN 0 THEN 'clock' ELSE 'reset' END AS kind, 'g' || o_orderkey || '.' || CASE f WHEN 0 THEN 'o_clock' ELSE 'o_reset' END AS net, instance_path FROM i WHERE f IN (0, 2)""",
)
def upstream(spark, d):
    """Inputs with plain names take the kind of the port that drives them; those of clocks and resets are left out."""
    ports = order_ports(spark, d).where("NOT (port_name LIKE '%clk%' OR port_name LIKE '%rst%')")
    port = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'o_clock' ELSE 'o_reset' END")
    feeds = ports.where("o_orderkey % 4 IN (0, 2)").select(port.alias("source_port"), F.concat(F.expr("concat('g', o_orderkey)"), F.lit("."), port).alias("source_path"), F.col("full_path").alias("dest_path"))
    return c.clock_reset_topology(ports, feeds)


@query("a8_clock_without_reset", f"{_TOPOLOGY} SELECT DISTINCT instance_path FROM topo WHERE kind = 'clock' AND instance_path NOT IN (SELECT instance_path FROM topo WHERE kind = 'reset')")
def no_reset(spark, d):
    return c.clocks_without_reset(_topology(spark, d))


def _nation_links(spark, d):
    x = links(spark, d)
    n = lambda s: F.substring_index(f"{s}_instance", ".", 1)
    return x.select(n("source").alias("source_instance"), n("dest").alias("dest_instance")).distinct().select("source_instance", "dest_instance", F.concat("source_instance", F.lit(".o_"), "dest_instance").alias("source_path"), F.concat("dest_instance", F.lit(".i_"), "source_instance").alias("dest_path"))


_NATIONS = f"""{LINKS}, nl AS (SELECT DISTINCT split_part(source_instance, '.', 1) AS s, split_part(dest_instance, '.', 1) AS t FROM links)"""


def _trace_sql(near: str, far: str) -> str:
    return f"""WITH RECURSIVE {_NATIONS}, walk(s, t, depth) AS (
  SELECT s, t, 0 FROM nl WHERE {near} = 'n1' UNION SELECT nl.s, nl.t, depth + 1 FROM walk JOIN nl ON nl.{near} = walk.{far} WHERE depth < 16
) SELECT s || '.o_' || t AS source_path, t || '.i_' || s AS dest_path, min(depth)::INT AS depth FROM walk GROUP BY ALL"""


@query("g1_trace_fan_out", _trace_sql("s", "t"))
def fan_out(spark, d):
    return c.trace(_nation_links(spark, d), "n1.*").select("source_path", "dest_path", "depth")


@query("g2_trace_fan_in", _trace_sql("t", "s"))
def fan_in(spark, d):
    return c.trace(_nation_links(spark, d), "n1.*", "in").select("source_path", "dest_path", "depth")


@query(
    "g5_net_components",
    """WITH RECURSIVE e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 2 AND a.c_nationkey % 5 = b.c_nationkey % 5 AND a.c_custkey <> b.c_custkey),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, seen) AS (SELECT a, b FROM s UNION SELECT walk.node, s.b FROM walk JOIN s ON walk.seen = s.a)
SELECT node, least(node, min(seen)) AS component FROM walk GROUP BY node""",
)
def net_components(spark, d):
    cu = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    up = cu.select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("bn"))
    edges = cu.join(up, (F.expr("c_custkey div 2") == F.col("b")) & (F.col("c_nationkey") % 5 == F.col("bn") % 5)).where("c_custkey <> b").select(F.col("c_custkey").alias("a"), "b")
    return components(edges)


@query(
    "e9_driver_load_links",
    """WITH RECURSIVE al AS (SELECT o_orderkey AS a, o_orderkey // 10 AS b, o_orderkey % 4 = 0 AS loose FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey > 9),
s AS (SELECT a, b FROM al UNION SELECT b, a FROM al), walk(node, seen) AS (SELECT a, b FROM s UNION SELECT walk.node, s.b FROM walk JOIN s ON walk.seen = s.a),
comp AS (SELECT 'net' || node AS node, least('net' || node, min('net' || seen)) AS canon FROM walk GROUP BY walk.node), loose AS (SELECT canon, bool_or(loose) AS loose FROM al JOIN comp ON 'net' || al.a = comp.node GROUP BY ALL),
bind AS (SELECT o_orderkey, 'net' || o_orderkey AS net, o_orderkey % 2 = 1 AS drv FROM orders),
named AS (SELECT o_orderkey, drv, coalesce(comp.canon, net) AS canon, coalesce(loose.loose, false) AS loose FROM bind LEFT JOIN comp ON comp.node = bind.net LEFT JOIN loose ON loose.canon = comp.canon)
SELECT 'i' || s.o_orderkey || '.p' AS source_path, 'i' || t.o_orderkey || '.p' AS dest_path, CASE WHEN s.loose OR s.o_orderkey % 5 = 0 OR t.o_orderkey % 5 = 0 THEN 'Approximate' ELSE 'Direct' END AS kind
FROM named s JOIN named t ON s.canon = t.canon WHERE s.drv AND NOT t.drv""",
)
def driver_load(spark, d):
    o = t(spark, d, "orders").select("o_orderkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    key = F.col("o_orderkey")
    bindings = o.select(name("i", key).alias("instance_path"), F.lit("p").alias("port_name"), name("net", key).alias("net_key"), (key % 2 == 1).alias("is_driver"), F.when(key % 5 == 0, "Approximate").otherwise("Direct").alias("kind"))
    ports = o.select(name("i", key).alias("instance_path"), F.lit("p").alias("port_name"), F.lit(1).alias("width"), F.lit(False).alias("is_signed"))
    aliases = o.where("o_orderkey % 3 = 0 AND o_orderkey > 9").select(name("net", key).alias("lhs_key"), name("net", F.expr("o_orderkey div 10")).alias("rhs_key"), (key % 4 == 0).alias("approximate"))
    return c.build_connections(ports, bindings, aliases).select("source_path", "dest_path", "kind")


@query("f1_ignore_tie_off", f"WITH {LINKS} SELECT source_path, dest_path FROM links WHERE source_width <> 7 AND dest_path NOT IN (SELECT dest_path FROM links WHERE dest_width = 9) AND source_path NOT IN (SELECT source_path FROM links WHERE source_width = 7)")
def tie_off(spark, d):
    x = links(spark, d)
    tied = x.where("source_width = 7").select(F.col("source_path").alias("full_path")).unionAll(x.where("dest_width = 9").select(F.col("dest_path").alias("full_path"))).withColumn("tie_off", F.lit(True))
    ports = x.select(F.col("source_path").alias("full_path"))
    return c.drop_ports(x, ports, c.tied_ports(tied))[0].select("source_path", "dest_path")


@query("f2_ignore_no_connect", f"WITH {PORTS} SELECT full_path FROM ports WHERE o_orderkey % 7 NOT IN (2, 3)")
def no_connect(spark, d):
    ports = order_ports(spark, d)
    none = spark.createDataFrame([], "source_path string, dest_path string")
    return c.drop_ports(none, ports, c.no_connect_ports(ports))[1].select("full_path")


@query(
    "f7_name_functions",
    f"""WITH {PORTS} SELECT full_path, split_part(full_path, '.', -1) AS leaf, regexp_replace(port_name, '(.)[0-9]+$', '\\1') AS base, CASE WHEN width > 1 THEN port_name || '[' || (width - 1) || ':0]' ELSE port_name END AS ranged,
regexp_matches(port_name, '(?i)(^|_)(clk|clock|ck)($|_)') AS cdc_clock, regexp_matches(lower(port_name), 'reset|rstn|rst_n|rst') AS cdc_reset FROM ports""",
)
def name_functions(spark, d):
    p = order_ports(spark, d)
    return p.select("full_path", names.short_name(F.col("full_path")).alias("leaf"), names.strip_index(F.col("port_name")).alias("base"), names.port_range(F.col("port_name"), F.col("width")).alias("ranged"), names.is_cdc_clock(F.col("port_name")).alias("cdc_clock"), names.is_cdc_reset(F.col("port_name")).alias("cdc_reset"))

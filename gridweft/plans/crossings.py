"""Queries of the clock-domain operators over chains of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import cdc
from gridweft.plans.facts import FFS, clock_table, register_edges, registers
from gridweft.plans.registry import query, t
from gridweft.sinks import reports


def _relations(spark, d):
    """The first two event types divide one clock, the next two exclude each other by constraint."""
    names = sorted(r["event_type"] for r in t(spark, d, "events").select("event_type").distinct().collect())
    a, b, c, e = names[:4]
    return spark.createDataFrame([(a, b, "Divided", False, 0), (c, e, "PhysicallyExclusive", True, 1)], "a_id string, b_id string, relationship string, sdc_declared boolean, seq int"), names


def _detected(spark, d):
    relations, names = _relations(spark, d)
    false = spark.createDataFrame([(names[0], names[4])], "from_clk string, to_clk string")
    gated = spark.createDataFrame([(names[1],)], "source_id string")
    return cdc.detect_crossings(register_edges(spark, d), registers(spark, d), clock_table(spark, d), relations, false, gated)


_CATEGORIES = """nm AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS n FROM events), cx AS (
  SELECT e.*, src_dom || ':pos' AS source_domain, dst_dom || ':pos' AS dest_domain,
    CASE WHEN src_dom = n[1] AND dst_dom = n[5] THEN 'INFO' WHEN (src_dom = n[3] AND dst_dom = n[4]) OR (src_dom = n[4] AND dst_dom = n[3]) THEN 'INFO'
         WHEN (src_dom = n[1] AND dst_dom = n[2]) OR (src_dom = n[2] AND dst_dom = n[1]) THEN 'INFO' ELSE 'VIOLATION' END AS category,
    CASE WHEN src_dom = n[1] AND dst_dom = n[5] THEN 'info' WHEN (src_dom = n[3] AND dst_dom = n[4]) OR (src_dom = n[4] AND dst_dom = n[3]) THEN 'info'
         WHEN (src_dom = n[1] AND dst_dom = n[2]) OR (src_dom = n[2] AND dst_dom = n[1]) THEN 'low' ELSE 'high' END AS severity,
    CASE WHEN src_dom = n[1] AND dst_dom = n[5] THEN 'sdc_false_path' WHEN (src_dom = n[3] AND dst_dom = n[4]) OR (src_dom = n[4] AND dst_dom = n[3]) THEN 'sdc_clock_groups' END AS waive_reason,
    CASE WHEN (src_dom = n[3] AND dst_dom = n[4]) OR (src_dom = n[4] AND dst_dom = n[3]) THEN 'PhysicallyExclusive' WHEN (src_dom = n[1] AND dst_dom = n[2]) OR (src_dom = n[2] AND dst_dom = n[1]) THEN 'Divided' ELSE 'inferred_asynchronous' END AS relationship
  FROM edges e, nm WHERE src_dom <> dst_dom
)"""
_CHAIN = """nxt AS (SELECT src_path AS path, dst_path AS next FROM edges WHERE NOT has_comb AND src_dom = dst_dom AND n_in <= 1),
ch AS (SELECT a.path, CASE WHEN b.next IS NULL THEN 'two_ff' ELSE 'three_ff' END AS chain FROM nxt a LEFT JOIN nxt b ON b.path = a.next),
v1 AS (SELECT cx.* EXCLUDE (category, severity), coalesce(chain, 'none') AS sync_type, CASE WHEN chain IS NULL THEN category ELSE 'INFO' END AS category, CASE WHEN chain IS NULL THEN severity ELSE 'info' END AS severity FROM cx LEFT JOIN ch ON ch.path = cx.dst_path),
v2 AS (SELECT v1.* EXCLUDE (category, severity), CASE WHEN has_comb THEN 'CAUTION' ELSE category END AS category, CASE WHEN has_comb THEN 'medium' ELSE severity END AS severity, CASE WHEN has_comb THEN 'Ac_cdc02' ELSE 'Ac_cdc01' END AS rule FROM v1),
v3c AS (SELECT *, count(*) OVER (PARTITION BY source_domain, dest_domain) AS n FROM v2),
v3 AS (SELECT v3c.* EXCLUDE (category, severity, rule), CASE WHEN n >= 2 AND sync_type <> 'none' AND rule = 'Ac_cdc01' THEN 'CAUTION' ELSE category END AS category, CASE WHEN n >= 2 AND sync_type <> 'none' AND rule = 'Ac_cdc01' THEN 'medium' ELSE severity END AS severity, CASE WHEN n >= 2 AND sync_type <> 'none' AND rule = 'Ac_cdc01' THEN 'Ac_cdc03' ELSE rule END AS rule FROM v3c)"""
_HEAD = f"WITH {FFS}, {_CATEGORIES}"


@query("x_detect_crossings", f"{_HEAD} SELECT src_path AS source_signal, dst_path AS dest_signal, source_domain, dest_domain, category, severity, waive_reason, relationship FROM cx")
def detect(spark, d):
    return _detected(spark, d).select("source_signal", "dest_signal", "source_domain", "dest_domain", "category", "severity", "waive_reason", "relationship")


_CLOCKS = {"a": "clk_a", "b": "b", "c": "clk_c", "d": "ckd_"}


@query(
    "x_ladder",
    """SELECT 'i' || event_id AS cell, CASE event_id % 6 WHEN 0 THEN 'INFO' WHEN 2 THEN 'INFO' WHEN 3 THEN 'INFO' WHEN 1 THEN 'VIOLATION' ELSE 'CAUTION' END AS category,
CASE event_id % 6 WHEN 1 THEN 'high' WHEN 4 THEN 'medium' WHEN 5 THEN 'medium' ELSE 'info' END AS severity, CASE event_id % 6 WHEN 0 THEN 'two_ff' WHEN 2 THEN 'handshake' ELSE 'none' END AS sync_type,
CASE event_id % 6 WHEN 3 THEN 'LogicallyExclusive' WHEN 4 THEN 'Divided' WHEN 5 THEN 'SameSource' ELSE 'inferred_asynchronous' END AS relationship, CASE event_id % 6 WHEN 3 THEN 'ckd_' WHEN 4 THEN '' WHEN 5 THEN '' ELSE 'b' END AS odd_names FROM events""",
)
def ladder(spark, d):
    """Each event is a cell with two registers: known cells, exclusive, divided and the same clock, and none of these."""
    kind = F.col("event_id") % 6
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (kind + 1).cast("int"))
    e = t(spark, d, "events").select(F.expr("concat('i', event_id)").alias("cell"), F.col("event_id").cast("int").alias("seq"), pick("regA", "regA", "src_req_q", "x", "x", "x").alias("from"), pick("regB", "regB", "dst_req_q", "y", "y", "y").alias("to"), pick("SyncReg", "my_syncreg", "ISOCHRONOUS_4phase_handshake", "m", "m", "m").alias("primitive"), pick("a", "a", "a", "c", "a", "a").alias("from_clk"), pick("b", "b", "b", "d", "c", "a").alias("to_clk"), F.when(kind == 5, "neg").otherwise("pos").alias("to_edge"))
    path = lambda c: F.concat_ws(".", "cell", c)
    ffs = e.select(path("from").alias("hier_path"), F.col("from_clk").alias("source_id"), F.lit("pos").alias("edge"), "primitive").unionAll(e.select(path("to"), "to_clk", "to_edge", "primitive"))
    sources = spark.createDataFrame([(k, n, n, None, 1.0) for k, n in _CLOCKS.items()], "source_id string, name string, origin_signal string, master_id string, period_ns double")
    relations = spark.createDataFrame([("c", "d", "LogicallyExclusive", False, 0), ("a", "c", "Divided", False, 1)], "a_id string, b_id string, relationship string, sdc_declared boolean, seq int")
    found = cdc.detect_crossings(e.select(path("from").alias("src_path"), path("to").alias("dst_path"), "seq"), ffs, sources, relations, spark.createDataFrame([], "from_clk string, to_clk string"), spark.createDataFrame([], "source_id string"))
    return found.select(F.substring_index("source_signal", ".", 1).alias("cell"), "category", "severity", "sync_type", "relationship", F.regexp_extract("recommendation", "ck: (.*)$", 1).alias("odd_names"))


@query("x11_timing_basis", f"{_HEAD} SELECT src_path AS source_signal, dst_path AS dest_signal, length(dst_dom)::DOUBLE AS timing_basis_ns FROM cx")
def timing(spark, d):
    return _detected(spark, d).select("source_signal", "dest_signal", "timing_basis_ns")


@query("a2_category_counts", f"{_HEAD} SELECT count_if(category = 'VIOLATION')::BIGINT AS violation, count_if(category = 'CAUTION')::BIGINT AS caution, count_if(category = 'INFO')::BIGINT AS info, 0::BIGINT AS waived, 0::BIGINT AS convention FROM cx")
def categories(spark, d):
    return cdc.category_counts(_detected(spark, d))


@query("f6_ignore_gated", f"{_HEAD} SELECT category, count(*) AS n FROM cx WHERE severity <> 'low' GROUP BY ALL")
def gated(spark, d):
    return cdc.ignore_gated(_detected(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _chained(spark, d):
    return cdc.verify_chain(_detected(spark, d), registers(spark, d), register_edges(spark, d))


@query("v1_sync_chain", f"{_HEAD}, {_CHAIN} SELECT src_path AS source_signal, dst_path AS dest_signal, sync_type, category FROM v1")
def chain(spark, d):
    return _chained(spark, d).select("source_signal", "dest_signal", "sync_type", "category")


def _commed(spark, d):
    return cdc.verify_comb(_chained(spark, d), register_edges(spark, d))


@query("v2_comb_before_sync", f"{_HEAD}, {_CHAIN} SELECT src_path AS source_signal, dst_path AS dest_signal, category, severity, rule FROM v2")
def comb(spark, d):
    return _commed(spark, d).select("source_signal", "dest_signal", "category", "severity", "rule")


def _converged(spark, d):
    return cdc.verify_reconvergence(_commed(spark, d))


@query("v3_reconvergence", f"{_HEAD}, {_CHAIN} SELECT src_path AS source_signal, dst_path AS dest_signal, category, severity, rule FROM v3")
def reconvergence(spark, d):
    return _converged(spark, d).select("source_signal", "dest_signal", "category", "severity", "rule")


@query(
    "v4_wide_bus",
    f"""{_HEAD}, {_CHAIN} SELECT src_path AS source_signal, dst_path AS dest_signal, CASE WHEN hit THEN 'Ac_cdc04' ELSE rule END AS rule, CASE WHEN hit THEN 'CAUTION' ELSE category END AS category
FROM (SELECT v3.*, sync_type <> 'none' AND rule <> 'Ac_cdc02' AND width >= 2 AND NOT regexp_matches(src_path, 'req|ack') AS hit FROM v3 JOIN ffs ON ffs.hier_path = src_path)""",
)
def bus(spark, d):
    return cdc.verify_bus(_converged(spark, d), registers(spark, d)).select("source_signal", "dest_signal", "rule", "category")


@query(
    "v7_handshake",
    f"""{_HEAD}, {_CHAIN}, pr AS (SELECT source_domain AS s, dest_domain AS t, bool_or(contains(src_path, 'req')) AS r, bool_or(contains(src_path, 'ack')) AS k FROM v2 WHERE sync_type <> 'none' GROUP BY ALL),
g AS (SELECT a.s, a.t FROM pr a JOIN pr b ON a.s = b.t AND a.t = b.s WHERE (a.r AND b.k) OR (a.k AND b.r))
SELECT source_domain, dest_domain, CASE WHEN g.s IS NOT NULL AND sync_type <> 'none' THEN 'handshake' ELSE sync_type END AS sync_type, count(*) AS n FROM v2 LEFT JOIN g ON g.s = source_domain AND g.t = dest_domain GROUP BY ALL""",
)
def handshake(spark, d):
    return cdc.verify_handshake(_commed(spark, d)).groupBy("source_domain", "dest_domain", "sync_type").agg(F.count(F.lit(1)).alias("n"))


@query("v10_fanout", f"{_HEAD}, {_CHAIN}, o AS (SELECT src_path AS p, count(*) AS n FROM (SELECT src_path FROM edges UNION ALL SELECT src_path FROM edges WHERE seq % 3 = 0) GROUP BY ALL) SELECT v2.src_path AS source_signal, dst_path AS dest_signal, CASE WHEN sync_type <> 'none' AND o.n > 1 THEN 'Ac_cdc05' ELSE rule END AS rule FROM v2 LEFT JOIN o ON o.p = dst_path")
def fanout(spark, d):
    edges = register_edges(spark, d)
    return cdc.verify_fanout(_commed(spark, d), edges.unionAll(edges.where("seq % 3 = 0"))).select("source_signal", "dest_signal", "rule")


@query("v14_many_domains", f"{_HEAD}, u AS (SELECT 'u' || user_id AS s, source_domain, dest_domain, category FROM cx JOIN ffs ON hier_path = dst_path), m AS (SELECT s FROM u GROUP BY s HAVING count(DISTINCT dest_domain) >= 2) SELECT s AS source_signal, dest_domain, CASE WHEN m.s IS NOT NULL AND category = 'INFO' THEN 'CAUTION' ELSE category END AS category, count(*) AS n FROM u LEFT JOIN m USING (s) GROUP BY ALL")
def many(spark, d):
    rows = _detected(spark, d).withColumn("source_signal", F.substring_index("source_signal", ".", 1))
    return cdc.verify_many_domains(rows).groupBy("source_signal", "dest_domain", "category").agg(F.count(F.lit(1)).alias("n"))


@query("v15_quasi_static", f"{_HEAD} SELECT src_path AS source_signal, dst_path AS dest_signal, 'Ac_cdc12' AS rule FROM cx JOIN ffs ON hier_path = src_path WHERE contains(src_path, 'cfg_') OR len(fanin) = 0 UNION ALL SELECT src_path, dst_path, 'Ac_cdc01' FROM cx")
def quasi_static(spark, d):
    return cdc.verify_quasi_static(_detected(spark, d), registers(spark, d)).select("source_signal", "dest_signal", "rule")


@query("v13_clock_as_data", f"WITH {FFS} SELECT 'x' AS source_signal, hier_path AS dest_signal, 'Ac_cdc09' AS rule FROM ffs WHERE len(fanin) > 0")
def clock_data(spark, d):
    clocks = clock_table(spark, d).unionByName(spark.createDataFrame([("x", "x", "x", None, 1.0, 9)], clock_table(spark, d).schema))
    none = _detected(spark, d).limit(0)
    return cdc.verify_clock_as_data(none, registers(spark, d), clocks).select("source_signal", "dest_signal", "rule")


_PHASES = """v4 AS (SELECT x.* EXCLUDE (category, severity, rule, hit), CASE WHEN hit THEN 'CAUTION' ELSE category END AS category, CASE WHEN hit THEN 'Ac_cdc04' ELSE rule END AS rule, regexp_replace(src_path, '[0-9]+$', '') AS prefix
  FROM (SELECT v3.*, sync_type <> 'none' AND rule <> 'Ac_cdc02' AND width >= 2 AND NOT regexp_matches(src_path, 'req|ack') AS hit FROM v3 JOIN ffs ON ffs.hier_path = src_path) x),
v5 AS (SELECT v4.* EXCLUDE (sync_type), CASE WHEN sync_type <> 'none' AND count(*) FILTER (sync_type <> 'none') OVER (PARTITION BY source_domain, dest_domain, prefix) >= 3 THEN 'gray_code' ELSE sync_type END AS sync_type FROM v4),
both_ways AS (SELECT source_domain AS s, dest_domain AS t, bool_or(contains(src_path, 'req')) AS r, bool_or(contains(src_path, 'ack')) AS k FROM v5 WHERE sync_type IN ('two_ff', 'three_ff') GROUP BY ALL),
shakes AS (SELECT a.s, a.t FROM both_ways a JOIN both_ways b ON a.s = b.t AND a.t = b.s WHERE (a.r AND b.k) OR (a.k AND b.r)),
v7 AS (SELECT v5.* EXCLUDE (sync_type), CASE WHEN shakes.s IS NOT NULL AND sync_type IN ('two_ff', 'three_ff') THEN 'handshake' ELSE sync_type END AS sync_type FROM v5 LEFT JOIN shakes ON shakes.s = source_domain AND shakes.t = dest_domain),
wraps AS (SELECT DISTINCT prefix FROM v7 JOIN ffs ON hier_path = src_path WHERE sync_type = 'gray_code' AND list_contains(fanin, 'depth')),
v12 AS (SELECT src_path, sync_type, CASE WHEN sync_type = 'gray_code' AND wraps.prefix IS NOT NULL THEN 'CAUTION' ELSE category END AS category, CASE WHEN sync_type = 'gray_code' AND wraps.prefix IS NOT NULL THEN 'Ac_cdc07' ELSE rule END AS rule FROM v7 LEFT JOIN wraps USING (prefix)),
v15 AS (SELECT rule, category, sync_type FROM v12 UNION ALL SELECT 'Ac_cdc12', 'INFO', sync_type FROM v12 JOIN ffs ON hier_path = src_path WHERE contains(src_path, 'cfg_') OR len(fanin) = 0)"""


@query("v_all_phases", f"{_HEAD}, {_CHAIN}, {_PHASES} SELECT rule, category, sync_type, count(*) AS n FROM v15 GROUP BY ALL")
def all_phases(spark, d):
    found = cdc.verify(_detected(spark, d), registers(spark, d), register_edges(spark, d), clock_table(spark, d))
    return found.groupBy("rule", "category", "sync_type").agg(F.count(F.lit(1)).alias("n"))


@query("v16_cdc_waivers", f"{_HEAD} SELECT CASE WHEN starts_with(src_path, 'u1') OR starts_with(dst_path, 'u1') THEN 'WAIVED' ELSE category END AS category, count(*) AS n FROM cx GROUP BY ALL")
def cdc_waivers(spark, d):
    rules = spark.createDataFrame([("W1", "", "u1*", "known", "", "", 0), ("W2", "a -> b", "", "pair", "", "", 1)], "id string, crossing string, pattern string, reason string, owner string, date string, seq int")
    return cdc.apply_cdc_waivers(_detected(spark, d), rules).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a19_registers_per_domain", "SELECT event_type || ':pos' AS domain, count(*) AS n_ffs FROM events GROUP BY ALL")
def per_domain(spark, d):
    return cdc.registers_per_domain(registers(spark, d))


@query("w5_numbered", f"{_HEAD} SELECT src_path AS source_signal, dst_path AS dest_signal, category || '-' || row_number() OVER (PARTITION BY category ORDER BY src_path, dst_path) AS id FROM cx")
def numbered(spark, d):
    return cdc.numbered(_detected(spark, d)).select("source_signal", "dest_signal", "id")


@query("ks1_sdc_lines", f"{_HEAD} SELECT 'set_false_path -from [get_cells {{' || src_path || '}}] -to [get_cells {{' || dst_path || '}}]  ;# needs a synchronizer: ' || category || '-' || row_number() OVER (PARTITION BY category ORDER BY src_path, dst_path) AS line FROM cx")
def sdc_lines(spark, d):
    periods = clock_table(spark, d).select(F.concat("source_id", F.lit(":pos")).alias("domain"), "period_ns")
    return reports.sdc_lines(cdc.numbered(_detected(spark, d)), periods).select("line")


@query("w6_waiver_template", f"""{_HEAD}, r AS (SELECT src_path, dst_path, row_number() OVER (ORDER BY src_path, dst_path) AS seq FROM cx WHERE category = 'VIOLATION') SELECT seq::INT AS seq, printf('  - id: WAIVE-%03d', seq) || chr(10) || '    crossing: "' || src_path || ' -> ' || dst_path || '"' || chr(10) || '    reason: "TODO"' || chr(10) || '    owner: "TODO"' AS line FROM r""")
def waiver_template(spark, d):
    return reports.waiver_template(_detected(spark, d))


@query("k10_inferred_relations", "WITH s AS (SELECT c_custkey AS id, c_custkey // 8 AS m FROM customer), r AS (SELECT id, id // 8 AS g FROM s) SELECT 'k' || lpad(a.id::VARCHAR, 9, '0') AS a_id, 'k' || lpad(b.id::VARCHAR, 9, '0') AS b_id FROM r a JOIN r b ON a.g = b.g AND a.id < b.id")
def inferred(spark, d):
    name = lambda x: F.concat(F.lit("k"), F.lpad(x.cast("string"), 9, "0"))
    first = F.expr("(c_custkey div 8) * 8")
    first = F.when(first == 0, F.lit(1)).otherwise(first)
    rows = t(spark, d, "customer").select(name(F.col("c_custkey")).alias("source_id"), F.when(F.col("c_custkey") != first, name(first)).alias("master_id"))
    none = spark.createDataFrame([], "a_id string, b_id string")
    return cdc.inferred_relations(rows, none).select("a_id", "b_id")


@query("k2_auto_clocks", "SELECT DISTINCT 'auto_' || n AS source_id, n AS name FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'clk_' || p_size WHEN 1 THEN 'rst_clk_' || p_size WHEN 2 THEN 'sys_ck' || p_size ELSE 'clock' END AS n FROM part) WHERE regexp_matches(n, '(^|_)(clk|clock|ck)($|_)') AND NOT contains(n, 'rst') AND n <> 'clk_8'")
def auto_clocks(spark, d):
    n = F.expr("CASE p_size % 4 WHEN 0 THEN concat('clk_', p_size) WHEN 1 THEN concat('rst_clk_', p_size) WHEN 2 THEN concat('sys_ck', p_size) ELSE 'clock' END")
    ports = t(spark, d, "part").select(n.alias("port_name"), F.lit(True).alias("is_top"), F.lit("In").alias("direction")).distinct()
    return cdc.auto_clocks(ports, spark.createDataFrame([("clk_8",)], "origin_signal string")).select("source_id", "name")


@query("ks2_sva_lines", f"{_HEAD}, n AS (SELECT *, category || '-' || row_number() OVER (PARTITION BY category ORDER BY src_path, dst_path) AS id FROM cx) SELECT id, 'property p_' || replace(id, '-', '_') || '; @(posedge ' || dst_dom || ') $stable(' || src_path || '); endproperty' AS line FROM n WHERE category IN ('VIOLATION', 'CAUTION')")
def sva_lines(spark, d):
    return reports.sva_lines(cdc.numbered(_detected(spark, d)))

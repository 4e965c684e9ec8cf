"""Queries of the clock sources and of register edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import cdc
from gridweft.operators import clocks as k
from gridweft.plans.registry import query, t


def _instances(spark, d):
    s = t(spark, d, "supplier")
    module = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'my_pll' WHEN 1 THEN 'u_icg_x' WHEN 2 THEN 'logic' ELSE 'MMCM2' END")
    return s.select(F.expr("concat('n', s_nationkey, '.s', s_suppkey)").alias("path"), F.expr("concat('s', s_suppkey)").alias("name"), module.alias("module"))


def _nets(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.expr("concat('n', s_nationkey, '.s', s_suppkey, '.p', l_partkey)").alias("hier_path"), (F.col("l_partkey") % 50 == 0).alias("is_gated")).distinct()


@query("k6_pll_outputs", "SELECT DISTINCT 'primary_n' || s_nationkey || '.s' || s_suppkey || '.p' || l_partkey AS source_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 4 IN (0, 3) AND l_partkey % 2 = 0")
def plls(spark, d):
    ports = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.expr("concat('n', s_nationkey, '.s', s_suppkey)").alias("instance_path"), F.expr("concat('p', l_partkey)").alias("port_name"), F.expr("CASE WHEN l_partkey % 2 = 0 THEN 'Out' ELSE 'In' END").alias("direction"))
    return k.pll_clocks(_instances(spark, d), ports).select("source_id")


@query(
    "k8_gated_nets",
    """WITH net AS (SELECT DISTINCT s_nationkey AS n, s_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
gate AS (SELECT s_suppkey AS g, s_nationkey AS n, s_suppkey * 3 AS o, CASE WHEN s_suppkey % 3 = 0 THEN 'en' || s_suppkey END AS enable FROM supplier WHERE s_suppkey % 4 = 1),
driven AS (SELECT o, arg_max(coalesce(enable, ''), 'n' || n || '.s' || g) AS enable FROM gate GROUP BY o)
SELECT 'n' || n || '.s' || s || '.p' || p AS hier_path, p % 50 = 0 OR driven.o IS NOT NULL AS is_gated, nullif(enable, '') AS gate_enable, NULL::VARCHAR AS source_id FROM net LEFT JOIN driven ON driven.o = p
UNION ALL SELECT 'n' || n || '.p' || o, true, enable, CASE WHEN g % 2 = 1 THEN 'k' || g END FROM gate""",
)
def gates(spark, d):
    """Each supplier is a cell whose pins carry its own clock, an enable for some, and the net of a part."""
    s = t(spark, d, "supplier")
    path, parent = F.expr("concat('n', s_nationkey, '.s', s_suppkey)"), F.expr("concat('n', s_nationkey)")
    pins = F.explode(F.expr("filter(array(struct('clk_in' AS port_name, concat('c', s_suppkey) AS actual), struct('GCLK' AS port_name, concat('p', s_suppkey * 3) AS actual), struct('en_i' AS port_name, CASE WHEN s_suppkey % 3 = 0 THEN concat('en', s_suppkey) END AS actual)), x -> x.actual IS NOT NULL)"))
    rows = s.select(path.alias("instance_path"), parent.alias("parent_path"), pins.alias("p")).select("instance_path", "parent_path", "p.*")
    sources = s.where("s_suppkey % 2 = 1").select(F.expr("concat('k', s_suppkey)").alias("source_id"), F.expr("concat('c', s_suppkey)").alias("name"), F.lit("").alias("origin_signal"))
    nets = _nets(spark, d).withColumn("source_id", F.lit(None).cast("string"))
    return k.mark_gated(nets, _instances(spark, d), rows, sources).select("hier_path", "is_gated", "gate_enable", "source_id")


@query(
    "k1_constraint_sources",
    """WITH p AS (SELECT 'sdc_c' || c_custkey AS source_id, 'c' || c_custkey AS name, 'pin' || c_custkey AS origin_signal, c_custkey::DOUBLE AS period_ns FROM customer),
g AS (SELECT 'sdc_gen_g' || s_suppkey AS source_id, 'g' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'c' || (s_suppkey // 2) WHEN 1 THEN 'pin' || s_suppkey ELSE 'g' || (s_suppkey // 2) END AS src, s_suppkey AS k FROM supplier)
SELECT source_id, name, 'Primary' AS type, NULL::VARCHAR AS master_id, period_ns FROM p UNION ALL
SELECT g.source_id, g.name, 'Generated', coalesce(p.source_id, o.source_id), NULL FROM g LEFT JOIN p ON g.src IN (p.name, p.origin_signal) LEFT JOIN g o ON o.name = g.src AND o.k < g.k""",
)
def constraints(spark, d):
    primary = t(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("name"), F.col("c_custkey").cast("double").alias("period_ns"), F.expr("concat('pin', c_custkey)").alias("target"), F.col("c_custkey").alias("seq"))
    source = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat('c', s_suppkey div 2) WHEN 1 THEN concat('pin', s_suppkey) ELSE concat('g', s_suppkey div 2) END")
    made = t(spark, d, "supplier").select(F.expr("concat('g', s_suppkey)").alias("name"), source.alias("source"), F.expr("concat('out', s_suppkey)").alias("target"), F.lit(2).alias("divide_by"), F.lit(1).alias("multiply_by"), F.lit(False).alias("invert"), F.col("s_suppkey").alias("seq"))
    return cdc.constraint_sources(primary, made).select("source_id", "name", "type", "master_id", "period_ns")


@query("k5_sensitivity_clocks", "SELECT DISTINCT 'u' || user_id || '.' || s AS name FROM (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'sys_clk' WHEN 1 THEN 'clk_rst' WHEN 2 THEN 'block' ELSE 'ck' || (event_id % 3) END AS s FROM events) WHERE s = 'sys_clk' AND user_id % 7 <> 0")
def sensitivity(spark, d):
    e = t(spark, d, "events").select(F.expr("concat('u', user_id)").alias("scope_path"), F.expr("CASE event_id % 4 WHEN 0 THEN 'sys_clk' WHEN 1 THEN 'clk_rst' WHEN 2 THEN 'block' ELSE concat('ck', event_id % 3) END").alias("signal"), "user_id")
    nets = e.where("user_id % 7 = 0").select(F.concat_ws(".", "scope_path", "signal").alias("hier_path"))
    return k.sensitivity_clocks(e, nets).select("name")


@query("k7_dividers", "SELECT 'generated_u' || user_id || '.q' || event_id AS source_id, event_type AS master_id, 2 AS divide_by FROM events WHERE event_id % 3 = 0 AND event_id % 5 = 0")
def divided(spark, d):
    e = t(spark, d, "events").select(F.expr("concat('u', user_id, '.q', event_id)").alias("hier_path"), F.col("event_type").alias("source_id"), (F.col("event_id") % 3 == 0).alias("inverted"), "event_id")
    return k.dividers(e, e.where("event_id % 5 = 0").select(F.col("hier_path").alias("signal"))).select("source_id", "master_id", "divide_by")


@query("k11_unsafe_clocks", "SELECT event_id::VARCHAR AS source_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND event_id % 3 <> 0 AND event_id % 7 <> 0")
def unsafe(spark, d):
    e = t(spark, d, "events")
    name = F.col("event_id").cast("string")
    first = e.agg(F.min("event_type").alias("m"))
    sources = e.select(name.alias("source_id"), name.alias("origin_signal"), F.when(F.col("event_id") % 3 == 0, "Sdc").otherwise("AutoDetected").alias("type"))
    assigns = e.join(first, F.col("event_type") == F.col("m"), "left").select(name.alias("lhs"), F.when(F.col("m").isNotNull(), "mux").otherwise("alias").alias("op"))
    return k.unsafe_clocks(sources, assigns, e.where("event_id % 7 = 0").select(name.alias("signal")))


@query("e16_register_edges", "SELECT 'a.r' || (event_id // 2) AS src_path, 'a.r' || event_id AS dst_path, event_id % 3 = 0 AND event_id % 2 = 0 AS has_comb FROM events WHERE event_id > 1")
def edges(spark, d):
    e = t(spark, d, "events").where("event_id > 0")
    ffs = e.select(F.expr("concat('a.r', event_id)").alias("hier_path"), F.when(F.col("event_id") % 3 == 0, F.array(F.expr("concat('w', event_id)"))).otherwise(F.array(F.expr("concat('r', event_id div 2, '[0]')"))).alias("fanin"))
    assigns = e.where("event_id % 3 = 0").select(F.expr("concat('a.w', event_id)").alias("lhs"), F.array(F.expr("concat('a.r', event_id div 2)")).alias("rhs"), F.when(F.col("event_id") % 2 == 0, "binary").otherwise("alias").alias("op"), F.lit("assign").alias("kind"), F.lit(0).alias("seq"))
    return k.register_edges(ffs, assigns)

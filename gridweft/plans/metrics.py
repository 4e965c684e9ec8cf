"""Queries of the complexity metrics over the tree of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import metrics as m
from gridweft.plans.facts import NODES, expression_nodes
from gridweft.plans.registry import query, t


def _roots(spark, d):
    """Every signal of the tree but its top: odd events are outputs, even ones inputs of registers."""
    name = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    return t(spark, d, "events").where("event_id > 0").select(name.alias("root_id"), F.when(F.col("event_id") % 2 == 1, "output").otherwise("ff_d").alias("root_kind"), name.alias("signal"))


_CONE = f"""WITH RECURSIVE {NODES}, roots(k) AS (SELECT event_id FROM events WHERE event_id > 0), walk(k, signal, depth) AS (
  SELECT k, 's' || k, 0 FROM roots UNION ALL SELECT k, input, depth + 1 FROM walk JOIN nodes ON output = signal WHERE depth < 256
), cone AS (SELECT k, n.*, depth, op_kind || ':' || op_detail || ':' || bit_width || ':1' AS sig FROM walk JOIN nodes n ON n.output = walk.signal)"""


def _cones(spark, d):
    nodes = expression_nodes(spark, d)
    return (*m.cones(nodes, _roots(spark, d)), nodes)


@query(
    "g3_cone_summary",
    f"""{_CONE}, a AS (SELECT k, count(*) AS raw, count(DISTINCT sig) AS unique_ops, count_if(approximate) AS n_approximate FROM cone GROUP BY k),
b AS (SELECT k, count_if(signal NOT IN (SELECT output FROM nodes)) AS n_sources, max(depth) AS depth FROM walk GROUP BY k)
SELECT 's' || k AS root_id, n_sources::BIGINT AS n_sources, depth::INT AS depth, coalesce(raw, 0) AS raw, coalesce(unique_ops, 0) AS unique_ops, coalesce(n_approximate, 0)::BIGINT AS n_approximate FROM b LEFT JOIN a USING (k)""",
)
def cone_summary(spark, d):
    cone, signals, nodes = _cones(spark, d)
    return m.cone_summary(cone, signals, nodes).drop("root_kind")


_NORM = f"""{_CONE}, lanes AS (SELECT k, sig, count(*) AS multiplicity, min(bit_width) AS least, arg_min(bit_width, node_id) AS width FROM cone GROUP BY ALL),
rest AS (SELECT cone.* FROM cone JOIN lanes USING (k, sig) WHERE NOT (multiplicity >= 2 AND least >= 2)),
strides AS (SELECT k, bit_width, count(*) AS multiplicity FROM rest WHERE op_kind = 'Slice' AND bit_width >= 2 GROUP BY ALL),
parts AS (SELECT k, count(*) AS n FROM lanes WHERE multiplicity >= 2 AND least >= 2 GROUP BY k UNION ALL SELECT k, count(*) FROM strides GROUP BY k UNION ALL SELECT k, count(*) FROM rest WHERE NOT (op_kind = 'Slice' AND bit_width >= 2) GROUP BY k),
groups AS (SELECT k, sig AS signature, multiplicity, width FROM lanes WHERE multiplicity >= 2 AND least >= 2 UNION ALL SELECT k, 'stride:' || bit_width || ':1', multiplicity, bit_width FROM strides WHERE multiplicity >= 2)"""


@query("a21_normalized_counts", f"{_NORM} SELECT 's' || k AS root_id, sum(n)::BIGINT AS norm FROM parts GROUP BY k")
def normalized(spark, d):
    cone, _, nodes = _cones(spark, d)
    return m.normalize(cone, nodes)[0].select("root_id", "norm")


@query("a22_normalized_groups", f"{_NORM} SELECT 's' || k AS root_id, signature, multiplicity, width FROM groups")
def groups(spark, d):
    cone, _, nodes = _cones(spark, d)
    return m.normalize(cone, nodes)[1].drop("root_kind")


@query("a23_merged_groups", f"{_NORM} SELECT signature, sum(multiplicity)::BIGINT AS multiplicity, any_value(width) AS width FROM groups GROUP BY signature")
def merged(spark, d):
    cone, _, nodes = _cones(spark, d)
    return m.merged_groups(m.normalize(cone, nodes)[1])


@query("g4_ff_paths", f"{_CONE} SELECT DISTINCT input AS source, 's' || k AS dest FROM cone WHERE k % 2 = 0 AND substr(input, 2)::INT % 2 = 0")
def paths(spark, d):
    cone, _, nodes = _cones(spark, d)
    registers = _roots(spark, d).where("root_kind = 'ff_d'").select(F.col("root_id").alias("name"), F.col("signal").alias("q_signal"), F.col("signal").alias("d_signal"))
    return m.ff_paths(cone, nodes, registers)


_SUMMARY = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'output' ELSE 'ff_d' END AS root_kind, 'r' || l_orderkey % 500 AS root_id, count(*)::INT AS raw, max(l_linenumber)::INT AS depth, count(DISTINCT l_suppkey)::INT AS norm FROM lineitem {0} GROUP BY ALL"


def _summary(spark, d, keep="true"):
    item = t(spark, d, "lineitem").where(keep)
    kind = F.when(F.col("l_linenumber") % 2 == 0, "output").otherwise("ff_d")
    return item.groupBy(kind.alias("root_kind"), F.expr("concat('r', l_orderkey % 500)").alias("root_id")).agg(F.count(F.lit(1)).cast("int").alias("raw"), F.max("l_linenumber").cast("int").alias("depth"), F.countDistinct("l_suppkey").cast("int").alias("norm"))


_DIFF = f"""WITH b AS (SELECT * FROM ({_SUMMARY.format("WHERE l_orderkey % 3 < 2")}) WHERE raw % 5 <> 0), c AS (SELECT * FROM ({_SUMMARY.format("WHERE l_orderkey % 3 > 0")}) WHERE raw % 7 <> 0), x AS (
SELECT root_kind, root_id, CASE WHEN b.raw IS NULL THEN 'new' WHEN c.raw IS NULL THEN 'removed' WHEN c.raw > b.raw THEN 'regression' WHEN c.raw < b.raw THEN 'improvement' ELSE 'same' END AS change,
coalesce(c.raw, 0) - coalesce(b.raw, 0) AS d_raw, coalesce(c.depth, 0) - coalesce(b.depth, 0) AS d_depth, coalesce(c.norm, 0) - coalesce(b.norm, 0) AS d_norm FROM c FULL JOIN b USING (root_kind, root_id))"""


def _diff(spark, d):
    return m.diff_metrics(_summary(spark, d, "l_orderkey % 3 < 2").where("raw % 5 <> 0"), _summary(spark, d, "l_orderkey % 3 > 0").where("raw % 7 <> 0"))


@query("j7_metrics_diff", f"{_DIFF} SELECT * FROM x")
def diff(spark, d):
    return _diff(spark, d)


@query("a26_diff_totals", f"{_DIFF} SELECT count_if(change = 'regression')::BIGINT AS n_regression, count_if(change = 'improvement')::BIGINT AS n_improvement, count_if(change = 'new')::BIGINT AS n_new, count_if(change = 'removed')::BIGINT AS n_removed, sum(d_raw)::BIGINT AS d_raw FROM x")
def diff_totals(spark, d):
    return m.diff_totals(_diff(spark, d))


@query("o5_top_roots", f"SELECT * FROM ({_SUMMARY.format('')}) ORDER BY raw DESC, root_kind, root_id LIMIT 20")
def top(spark, d):
    return m.top_roots(_summary(spark, d), 20)


@query("a24_totals", f"SELECT sum(raw)::BIGINT AS raw, sum(norm)::BIGINT AS norm, max(raw) FILTER (root_kind = 'output') AS max_output, max(raw) FILTER (root_kind = 'ff_d') AS max_ff_d FROM ({_SUMMARY.format('')})")
def totals(spark, d):
    return m.totals(_summary(spark, d))


@query("a25_unsupported_events", "WITH e AS (SELECT event_type AS kind, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE '' END AS detail FROM events), s AS (SELECT kind, detail, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS k FROM e WHERE detail <> '') SELECT kind, (SELECT count(*) FROM e WHERE e.kind = s.kind) AS n, string_agg(detail, ',' ORDER BY seq) AS samples FROM s WHERE k <= 3 GROUP BY kind")
def unsupported(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).otherwise("").alias("detail"))
    return m.unsupported_events(e).select("kind", "n", F.array_join("samples", ",").alias("samples"))


@query("e26_best_registers", "WITH r AS (SELECT user_id::VARCHAR AS name, event_id % 3 = 0 AS d_const, event_id AS seq, event_type AS d_signal FROM events) SELECT name, d_signal FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY d_const, seq) = 1")
def best(spark, d):
    r = t(spark, d, "events").select(F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 3 == 0).alias("d_const"), F.col("event_id").alias("seq"), F.col("event_type").alias("d_signal"))
    return m.best_registers(r).select("name", "d_signal")


@query("e24_unrolled_loops", "SELECT p_partkey AS id, unnest(range(1, CASE WHEN p_size > 20 THEN 2 ELSE p_size + 1 END)) AS pass, p_size > 20 AS approximate FROM part")
def loops(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("start"), F.col("p_size").cast("long").alias("stop"))
    return m.unroll(rows, 20).select("id", F.col("pass").cast("long").alias("pass"), "approximate")

"""Queries of hierarchy, names and clock relations over trees of customers, nations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.functions import names
from gridweft.operators import cdc, clocks, connect, metrics
from gridweft.plans.facts import PORTS, order_ports
from gridweft.plans.registry import query, t
from gridweft.sinks import reports
from gridweft.sources import rules


def _tree(spark, d):
    """Customers as nets of a tree: the parent of net k is net k div 4."""
    return t(spark, d, "customer").where("c_custkey >= 4").select(F.expr("concat('c', c_custkey div 4)").alias("parent_net"), F.expr("concat('c', c_custkey)").alias("child_net"))


_TREE = "tree AS (SELECT 'c' || (c_custkey // 4) AS parent_net, 'c' || c_custkey AS child_net FROM customer WHERE c_custkey >= 4)"


@query("k3_propagated_clocks", f"WITH RECURSIVE {_TREE}, r AS (SELECT 'k' || c_custkey AS source_id, 'c' || c_custkey AS hier_path, 0 AS depth FROM customer WHERE 'c' || c_custkey NOT IN (SELECT child_net FROM tree) UNION ALL SELECT source_id, child_net, depth + 1 FROM r JOIN tree ON parent_net = hier_path) SELECT * FROM r")
def propagated(spark, d):
    """Clocks enter at the nets that no other net drives."""
    tree = _tree(spark, d)
    nets = t(spark, d, "customer").select(F.expr("concat('k', c_custkey)").alias("source_id"), F.expr("concat('c', c_custkey)").alias("hier_path"))
    return cdc.propagate_clocks(nets.join(tree.select(F.col("child_net").alias("hier_path")), "hier_path", "left_anti"), tree)


@query("k4_unified_clocks", f"WITH {_TREE} SELECT DISTINCT 'autodetected_' || parent_net AS source_id, parent_net AS name FROM tree WHERE substr(child_net, 2)::INT % 5 = 0 AND substr(parent_net, 2)::INT % 3 <> 0")
def unified(spark, d):
    c = t(spark, d, "customer")
    used = c.where("c_custkey % 5 = 0").select(F.expr("concat('c', c_custkey)").alias("child_net"))
    nets = c.where("c_custkey % 3 = 0").select(F.expr("concat('c', c_custkey)").alias("hier_path"))
    return clocks.unified_clocks(used, _tree(spark, d), nets).select("source_id", "name")


@query("g7_master_roots", "WITH RECURSIVE r AS (SELECT c_custkey AS k, c_custkey AS a FROM customer UNION ALL SELECT k, a // 4 FROM r WHERE a >= 4) SELECT 'c' || k AS source_id, 'c' || a AS root FROM r WHERE a < 4")
def roots(spark, d):
    return cdc.master_roots(t(spark, d, "customer").select(F.expr("concat('c', c_custkey)").alias("source_id"), F.expr("CASE WHEN c_custkey >= 4 THEN concat('c', c_custkey div 4) END").alias("master_id")))


@query("e3_depth_limit", "SELECT c_custkey % 6 AS depth, count(*) AS n FROM customer WHERE c_custkey % 6 <= 2 GROUP BY ALL")
def depth(spark, d):
    rows = t(spark, d, "customer").withColumn("depth", F.col("c_custkey") % 6)
    return connect.limit_depth(rows, 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("e4_inout_bindings", f"WITH {PORTS}, b AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'InOut' ELSE direction END AS dir FROM ports) SELECT full_path, dir = 'Out' OR dir = 'InOut' AND k = 1 AS is_driver FROM b, (VALUES (1), (2)) v(k) WHERE k = 1 OR dir = 'InOut'")
def inout(spark, d):
    rows = order_ports(spark, d).withColumn("direction", F.when(F.col("o_orderkey") % 5 == 0, "InOut").otherwise(F.col("direction")))
    return connect.expand_inout(rows).select("full_path", "is_driver")


@query("e11_interface_directions", "SELECT 's' || l_suppkey AS instance_path, 'p' || l_partkey AS port_name, CASE WHEN bool_or(l_linenumber % 4 = 3) OR (bool_or(l_linenumber % 4 IN (0, 1)) AND bool_or(l_linenumber % 4 = 2)) THEN 'InOut' WHEN bool_or(l_linenumber % 4 IN (0, 1)) THEN 'Out' ELSE 'In' END AS direction FROM lineitem GROUP BY l_suppkey, l_partkey")
def interface(spark, d):
    role = F.expr("CASE l_linenumber % 4 WHEN 2 THEN 'In' WHEN 3 THEN 'InOut' ELSE 'Out' END")
    return connect.interface_directions(t(spark, d, "lineitem").select(F.expr("concat('s', l_suppkey)").alias("instance_path"), F.expr("concat('p', l_partkey)").alias("port_name"), role.alias("member_direction")))


_CELL = "CASE p_partkey % 6 WHEN 0 THEN concat('my_dff_', p_size) WHEN 1 THEN concat('SDFF', p_size) WHEN 2 THEN 'xdffy' WHEN 3 THEN 'fdre' WHEN 4 THEN concat('u', p_size, 'fdce_x') ELSE 'buffer' END"


@query("e13_register_cells", f"SELECT p_partkey, {_CELL} AS module FROM part WHERE p_partkey % 6 IN (0, 1, 3, 4)")
def cells(spark, d):
    return t(spark, d, "part").select("p_partkey", F.expr(_CELL).alias("module")).where(names.is_register_cell(F.col("module")))


@query(
    "e14_register_clocks",
    """WITH f AS (SELECT 'u' || (user_id % 7) || '.v' || user_id || '.e' || event_id AS hier_path, user_id % 7 AS u, user_id AS v, CASE event_id % 3 WHEN 0 THEN 'ck' || (user_id % 10) WHEN 1 THEN 'lclk' ELSE 'zz' END AS clock FROM events)
SELECT hier_path, CASE WHEN clock = 'lclk' THEN CASE WHEN v % 2 = 0 THEN 'near' || v WHEN u <= 3 THEN 'far' || u END WHEN clock <> 'zz' AND v % 10 <= 4 THEN 's' || clock END AS source_id FROM f""",
)
def register_clocks(spark, d):
    e = t(spark, d, "events")
    ffs = e.select(F.expr("concat('u', user_id % 7, '.v', user_id, '.e', event_id)").alias("hier_path"), F.expr("CASE event_id % 3 WHEN 0 THEN concat('ck', user_id % 10) WHEN 1 THEN 'lclk' ELSE 'zz' END").alias("clock"))
    sources = spark.range(5).select(F.expr("concat('sck', id)").alias("source_id"), F.expr("concat('ck', id)").alias("name"), F.col("id").alias("seq"))
    near = e.where("user_id % 2 = 0").select(F.expr("concat('u', user_id % 7, '.v', user_id, '.lclk')").alias("hier_path"), F.expr("concat('near', user_id)").alias("source_id")).distinct()
    far = spark.range(4).select(F.expr("concat('u', id, '.lclk')").alias("hier_path"), F.expr("concat('far', id)").alias("source_id"))
    return cdc.register_domains(ffs, sources, near.unionAll(far)).select("hier_path", "source_id")


@query(
    "e17_resolved_names",
    """WITH known AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'a' || (c_custkey % 5) || '.b' || (c_custkey % 20) || '.' WHEN 1 THEN 'a' || (c_custkey % 5) || '.' ELSE '' END || 'x' || (c_custkey % 50) AS path FROM customer),
w AS (SELECT DISTINCT 'a' || (user_id % 5) AS a, 'b' || (user_id % 20) AS b, 'x' || (event_id % 50) AS bare, CASE WHEN event_id % 4 = 0 THEN '[1]' ELSE '' END AS ix FROM events),
o AS (SELECT a || '.' || b AS scope_path, bare || ix AS signal, unnest([{'r': 1, 'p': a || '.' || b || '.' || bare || ix}, {'r': 2, 'p': bare || ix}, {'r': 3, 'p': a || '.' || b || '.' || bare}, {'r': 4, 'p': bare}, {'r': 5, 'p': a || '.' || bare}]) AS c FROM w)
SELECT scope_path, signal, arg_min(c.p, c.r) AS path FROM o JOIN known ON path = c.p GROUP BY ALL""",
)
def resolved(spark, d):
    known = t(spark, d, "customer").select(F.expr("concat(CASE c_custkey % 3 WHEN 0 THEN concat('a', c_custkey % 5, '.b', c_custkey % 20, '.') WHEN 1 THEN concat('a', c_custkey % 5, '.') ELSE '' END, 'x', c_custkey % 50)").alias("path"))
    wanted = t(spark, d, "events").select(F.expr("concat('a', user_id % 5, '.b', user_id % 20)").alias("scope_path"), F.expr("concat('x', event_id % 50, CASE WHEN event_id % 4 = 0 THEN '[1]' ELSE '' END)").alias("signal"))
    return clocks.resolve_names(wanted, known)


@query("e19_comb_assigns", "WITH a AS (SELECT 'w' || user_id AS lhs, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS k, event_id, event_type FROM events) SELECT lhs, arg_min(event_type, k * 1000000000000 + event_id) AS op FROM a GROUP BY ALL")
def comb(spark, d):
    rows = t(spark, d, "events").select(F.expr("concat('w', user_id)").alias("lhs"), F.array("event_type").alias("rhs"), F.col("event_type").alias("op"), F.expr("CASE WHEN event_id % 7 = 0 THEN 'assign' ELSE 'comb' END").alias("kind"), F.col("event_id").alias("seq"))
    return clocks.comb_assigns(rows).select("lhs", "op")


@query("e27_root_list", f"WITH {PORTS} SELECT port_name AS root_id, 'output' AS root_kind, port_name AS signal FROM ports WHERE is_top AND direction = 'Out' UNION ALL SELECT 'r' || c_custkey, 'ff_d', 'd' || c_custkey FROM customer")
def root_list(spark, d):
    return metrics.root_list(order_ports(spark, d), t(spark, d, "customer").select(F.expr("concat('r', c_custkey)").alias("name"), F.expr("concat('d', c_custkey)").alias("d_signal")))


@query("f5_root_selection", f"WITH {PORTS} SELECT port_name AS root_id, 'output' AS root_kind, 'outputs' AS which FROM ports WHERE is_top AND direction = 'Out' UNION ALL SELECT 'r' || c_custkey, 'ff_d', 'ffd' FROM customer")
def root_selection(spark, d):
    regs = t(spark, d, "customer").select(F.expr("concat('r', c_custkey)").alias("name"), F.expr("concat('d', c_custkey)").alias("d_signal"))
    pick = lambda which: metrics.root_list(order_ports(spark, d), regs, which).select("root_id", "root_kind", F.lit(which).alias("which"))
    return pick("outputs").unionByName(pick("ffd"))


@query("j18_sliced_drivers", "SELECT 'w' || p_partkey AS signal, s AS node_id FROM part, (VALUES (0), (1)) v(s) WHERE s = 0 OR p_size % 3 <> 0")
def sliced(spark, d):
    """Two slices drive a part's word, of which some have a driver of their own name as well."""
    p = t(spark, d, "part")
    name = F.expr("concat('w', p_partkey)")
    node = lambda out, k: p.select(F.lit(k).cast("int").alias("node_id"), out.alias("output"), F.array(F.lit("x")).alias("inputs"), "p_size")
    nodes = node(F.concat(name, F.lit("[3:0]")), 0).unionAll(node(F.concat(name, F.lit("[7:4]")), 1)).where("p_size % 3 <> 0").unionAll(node(name, 0).where("p_size % 3 = 0")).unionAll(node(F.concat(name, F.lit("[1]")), 7).where("p_size % 3 = 0"))
    return metrics.driver_edges(nodes).where("signal NOT LIKE '%[%'").select("signal", "node_id")


@query("f3_glob_and_f4_star", "SELECT c_name, c_name LIKE '%#000%' || (c_custkey % 7) || '_' AS globbed, starts_with(c_name, 'Customer#0000000' || (c_custkey % 3)) AS starred FROM customer")
def globs(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_name", names.glob_match(F.col("c_name"), F.expr("concat('*#000*', c_custkey % 7, '?')")).alias("globbed"), names.trailing_star_match(F.col("c_name"), F.expr("concat('Customer#0000000', c_custkey % 3, '*')")).alias("starred"))


@query("s14_added_clocks", "SELECT 'k' || n_nationkey AS source_id, n_name AS name, 2.0::DOUBLE AS period_ns FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'yaml_' || n_name, n_name, 5.0 FROM nation WHERE n_nationkey % 2 = 1 AND n_regionkey <= 2")
def added(spark, d):
    n = t(spark, d, "nation")
    have = n.where("n_nationkey % 2 = 0").select(F.expr("concat('k', n_nationkey)").alias("source_id"), F.col("n_name").alias("name"), F.lit(2.0).alias("period_ns"))
    return rules.add_clocks(have, n.where("n_regionkey <= 2").select(F.col("n_name").alias("name"), F.lit(5.0).alias("period_ns")))


@query(
    "k9_declared_relations",
    """WITH k AS (SELECT 'k' || n_nationkey AS id, n_regionkey AS r FROM nation)
SELECT a.id AS a_id, b.id AS b_id, 'Asynchronous' AS relationship FROM k a, k b WHERE a.r = 0 AND b.r = 1 UNION ALL SELECT a.id, b.id, 'PhysicallyExclusive' FROM k a, k b WHERE a.r = 2 AND b.r <> 2""",
)
def declared(spark, d):
    n = t(spark, d, "nation")
    groups = n.where("n_regionkey <= 2").select(F.expr("CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END").alias("stmt"), F.expr("CASE WHEN n_regionkey = 2 THEN 'PhysicallyExclusive' ELSE 'Asynchronous' END").alias("kind"), F.expr("CASE WHEN n_regionkey = 2 THEN 0 ELSE n_regionkey END").alias("group_no"), F.col("n_name").alias("clock"))
    return cdc.declared_relations(groups, n.select(F.expr("concat('k', n_nationkey)").alias("source_id"), F.col("n_name").alias("name"))).select("a_id", "b_id", "relationship")


@query(
    "j13_relation_lookup",
    """WITH r AS (SELECT least(o_custkey % 40, o_orderkey % 50) AS a, 50 + o_custkey % 9 AS b, o_orderpriority AS p, o_orderkey % 8 = 0 AS s, o_orderkey AS q FROM orders), b AS (SELECT * FROM r UNION ALL SELECT b, a, p, s, q FROM r)
SELECT a AS a_id, b AS b_id, arg_min(p, CASE WHEN s THEN 0 ELSE 1000000000000 END + q) AS relationship, bool_or(s) AS sdc_declared FROM b GROUP BY ALL""",
)
def relations(spark, d):
    o = t(spark, d, "orders")
    return cdc.relation_lookup(o.select(F.expr("least(o_custkey % 40, o_orderkey % 50)").alias("a_id"), F.expr("50 + o_custkey % 9").alias("b_id"), F.col("o_orderpriority").alias("relationship"), (F.col("o_orderkey") % 8 == 0).alias("sdc_declared"), F.col("o_orderkey").alias("seq")))


@query("w9_property_names", "WITH i AS (SELECT 'i' || CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE '_' END || (c_custkey // 3) AS id FROM customer), n AS (SELECT id, regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') AS c FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY id) AS k FROM n) SELECT id, CASE WHEN k = 1 THEN c ELSE c || '_dup' || (k - 1) END AS name FROM k")
def property_names(spark, d):
    return reports.property_names(t(spark, d, "customer").select(F.expr("concat('i', CASE c_custkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE '_' END, c_custkey div 3)").alias("id")))


@query("a28_recall_precision", "WITH f AS (SELECT DISTINCT 'clk_' || n_name AS s, 'r' || n_regionkey || ':pos' AS t FROM nation), g AS (SELECT DISTINCT n_name AS s, 'r' || CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE n_regionkey END AS t FROM nation), h AS (SELECT f.s AS fs, f.t AS ft, g.s AS gs, g.t AS gt FROM f JOIN g ON contains(f.s, g.s) AND contains(f.t, g.t)) SELECT count(DISTINCT (gs, gt)) / (SELECT count(*) FROM g) AS recall, count(DISTINCT (fs, ft)) / (SELECT count(*) FROM f) AS precision FROM h")
def recall(spark, d):
    n = t(spark, d, "nation")
    found = n.select(F.concat(F.lit("clk_"), "n_name").alias("source_domain"), F.expr("concat('r', n_regionkey, ':pos')").alias("dest_domain"))
    return clocks.evaluate(found, n.select(F.col("n_name").alias("source"), F.expr("concat('r', CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE n_regionkey END)").alias("dest")))

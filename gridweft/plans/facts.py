"""Design facts derived from the driver's tables, and the same facts as SQL.

Suppliers drive order nets through part-wide ports and customers load them; events of a user are a
chain of registers whose type is their clock domain; event_id div 2 makes a tree of expressions;
documents are source files and pages are modules that instantiate what they link to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.plans.registry import t


def links(spark: SparkSession, d: str) -> DataFrame:
    item = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    rows = item.join(t(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.expr("concat('n', s_nationkey, '.s', s_suppkey)").alias("source_instance"), F.expr("concat('p', l_partkey)").alias("source_port"),
        F.expr("concat('n', s_nationkey, '.s', s_suppkey, '.p', l_partkey)").alias("source_path"), F.col("p_size").alias("source_width"), (F.col("p_size") % 2 == 0).alias("source_signed"),
        F.expr("concat('n', c_nationkey, '.c', c_custkey)").alias("dest_instance"), F.expr("concat('o', l_orderkey, '_', l_linenumber)").alias("dest_port"),
        F.expr("concat('n', c_nationkey, '.c', c_custkey, '.o', l_orderkey, '_', l_linenumber)").alias("dest_path"), F.col("q").alias("dest_width"), (F.col("q") % 3 == 0).alias("dest_signed"),
        F.when(F.col("l_returnflag") == "R", "Approximate").otherwise("Direct").alias("kind"),
    )


LINKS = """links AS (
  SELECT 'n' || s_nationkey || '.s' || s_suppkey AS source_instance, 'p' || l_partkey AS source_port,
         'n' || s_nationkey || '.s' || s_suppkey || '.p' || l_partkey AS source_path, p_size AS source_width, p_size % 2 = 0 AS source_signed,
         'n' || c_nationkey || '.c' || c_custkey AS dest_instance, 'o' || l_orderkey || '_' || l_linenumber AS dest_port,
         'n' || c_nationkey || '.c' || c_custkey || '.o' || l_orderkey || '_' || l_linenumber AS dest_path,
         l_quantity::INT AS dest_width, l_quantity::INT % 3 = 0 AS dest_signed,
         CASE WHEN l_returnflag = 'R' THEN 'Approximate' ELSE 'Direct' END AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
)"""


def order_ports(spark: SparkSession, d: str) -> DataFrame:
    """A port for each order: inputs of customers for even keys, outputs for others; names by priority."""
    rows = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.expr("concat(CASE WHEN o_orderkey % 2 = 0 THEN 'i_' ELSE 'o_' END, CASE o_orderkey % 7 WHEN 0 THEN 'clk' WHEN 1 THEN 'rst_n' WHEN 2 THEN 'NC' WHEN 3 THEN 'unused_q' ELSE 'data' END, '_', o_orderkey)")
    return rows.select(
        F.expr("concat('n', c_nationkey, '.c', c_custkey)").alias("instance_path"), name.alias("port_name"), F.concat_ws(".", F.expr("concat('n', c_nationkey, '.c', c_custkey)"), name).alias("full_path"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'In' ELSE 'Out' END").alias("direction"), F.expr("CAST(o_orderkey % 33 AS INT)").alias("width"), F.expr("o_orderkey % 3 = 0").alias("is_signed"), F.expr("o_orderkey % 11 = 0").alias("is_top"), F.col("o_orderkey").cast("int").alias("seq"), "o_orderkey",
    )


PORTS = """ports AS (
  SELECT 'n' || c_nationkey || '.c' || c_custkey AS instance_path, port_name, 'n' || c_nationkey || '.c' || c_custkey || '.' || port_name AS full_path,
         CASE WHEN o_orderkey % 2 = 0 THEN 'In' ELSE 'Out' END AS direction, (o_orderkey % 33)::INT AS width, o_orderkey % 3 = 0 AS is_signed, o_orderkey % 11 = 0 AS is_top, o_orderkey::INT AS seq, o_orderkey
  FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'i_' ELSE 'o_' END || CASE o_orderkey % 7 WHEN 0 THEN 'clk' WHEN 1 THEN 'rst_n' WHEN 2 THEN 'NC' WHEN 3 THEN 'unused_q' ELSE 'data' END || '_' || o_orderkey AS port_name FROM orders)
  JOIN customer ON o_custkey = c_custkey
)"""


def registers(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select(
        F.expr("concat('u', user_id, '.', CASE event_id % 5 WHEN 0 THEN 'req' WHEN 1 THEN 'ack' WHEN 2 THEN 'cfg_' ELSE 'd' END, event_id)").alias("hier_path"), F.col("event_type").alias("source_id"), F.lit("pos").alias("edge"),
        (F.col("event_id") % 3 + 1).cast("int").alias("width"), F.expr("CASE WHEN event_id % 4 = 0 THEN array() WHEN event_id % 9 = 0 THEN array('x', 'depth') ELSE array('x') END").alias("fanin"),
        F.lit(None).cast("string").alias("reset_path"), F.lit(False).alias("reset_async"), F.col("event_id").cast("int").alias("seq"), "user_id", "event_id",
    )


def register_edges(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    r = registers(spark, d)
    w = Window.partitionBy("user_id").orderBy("event_id")
    return r.select(F.lag("hier_path").over(w).alias("src_path"), F.col("hier_path").alias("dst_path"), (F.col("event_id") % 6 == 0).alias("has_comb"), "seq").where("src_path IS NOT NULL")


FFS = """ffs AS (
  SELECT 'u' || user_id || '.' || CASE event_id % 5 WHEN 0 THEN 'req' WHEN 1 THEN 'ack' WHEN 2 THEN 'cfg_' ELSE 'd' END || event_id AS hier_path, event_type AS source_id, 'pos' AS edge,
         (event_id % 3 + 1)::INT AS width, CASE WHEN event_id % 4 = 0 THEN [] WHEN event_id % 9 = 0 THEN ['x', 'depth'] ELSE ['x'] END AS fanin, event_id::INT AS seq, user_id, event_id
  FROM events
), edges AS (
  SELECT * FROM (SELECT lag(hier_path) OVER w AS src_path, hier_path AS dst_path, event_id % 6 = 0 AS has_comb, seq, lag(source_id) OVER w AS src_dom, source_id AS dst_dom, len(fanin) AS n_in
  FROM ffs WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE src_path IS NOT NULL
)"""


def clock_table(spark: SparkSession, d: str) -> DataFrame:
    """A clock for each event type; the first letters decide masters and periods."""
    e = t(spark, d, "events").select(F.col("event_type").alias("source_id")).distinct()
    return e.select("source_id", F.col("source_id").alias("name"), F.col("source_id").alias("origin_signal"), F.lit(None).cast("string").alias("master_id"), F.length("source_id").cast("double").alias("period_ns"), F.length("source_id").alias("seq"))


def expression_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.where("event_id > 0").select(
        F.col("event_id").alias("node_id"), F.when(F.col("event_id") % 5 == 0, "Slice").otherwise(F.col("event_type")).alias("op_kind"), (F.col("event_id") % 3).cast("string").alias("op_detail"),
        F.concat(F.lit("s"), (F.col("event_id") / 2).cast("long").cast("string")).alias("output"), F.array(F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("inputs"),
        (F.col("event_id") % 4 + 1).cast("int").alias("bit_width"), (F.col("event_id") % 10 == 0).alias("approximate"),
    )


NODES = """nodes AS (
  SELECT event_id AS node_id, CASE WHEN event_id % 5 = 0 THEN 'Slice' ELSE event_type END AS op_kind, (event_id % 3)::VARCHAR AS op_detail,
         's' || (event_id // 2) AS output, 's' || event_id AS input, (event_id % 4 + 1)::INT AS bit_width, event_id % 10 = 0 AS approximate
  FROM events WHERE event_id > 0
)"""

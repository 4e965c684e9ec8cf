"""Queries of the verification phases that look for groups of crossings, chains and resets."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweft.operators import cdc
from gridweft.plans.facts import FFS, registers
from gridweft.plans.registry import query, t


def _rows(spark, d, kind="CASE WHEN event_id % 2 = 0 THEN 'two_ff' ELSE 'none' END"):
    """A crossing for each event: bits of pointers and counters that leave the event's domain."""
    e = t(spark, d, "events")
    none = F.lit(None).cast("string")
    return e.select(
        F.expr("concat('c', event_id)").alias("cid"), F.expr("concat('m.', CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END, user_id, '[', event_id, ']')").alias("source_signal"), F.expr("concat('q', event_id)").alias("dest_signal"),
        F.col("event_type").alias("source_domain"), F.expr("concat('t', user_id % 3)").alias("dest_domain"), none.alias("relationship"), F.lit("VIOLATION").alias("category"), F.lit("high").alias("severity"), F.expr(kind).alias("sync_type"),
        F.lit("Ac_cdc01").alias("rule"), F.lit("").alias("subrule"), none.alias("waive_reason"), F.lit("").alias("recommendation"), F.lit(None).cast("double").alias("timing_basis_ns"),
    )


_ROWS = """x AS (SELECT 'c' || event_id AS cid, 'm.' || CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END || user_id AS prefix, event_type AS source_domain, 't' || (user_id % 3) AS dest_domain,
  CASE WHEN event_id % 2 = 0 THEN 'two_ff' ELSE 'none' END AS sync_type, user_id, event_id FROM events)"""


@query("v6_gray_code", f"WITH {_ROWS}, n AS (SELECT *, count_if(sync_type <> 'none') OVER (PARTITION BY source_domain, dest_domain, prefix) AS n FROM x) SELECT cid, CASE WHEN sync_type = 'none' OR n < 3 THEN sync_type WHEN user_id % 2 = 0 THEN 'async_fifo' ELSE 'gray_code' END AS sync_type FROM n")
def gray(spark, d):
    return cdc.verify_gray(_rows(spark, d)).select("cid", "sync_type")


def _sources(spark, d):
    """Source registers of the crossings: some take their own prefix, some a depth."""
    own = F.expr("concat(CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END, user_id, '[0]')")
    fanin = F.when(F.col("user_id") % 5 == 0, F.array(own)).when(F.col("user_id") % 5 == 1, F.array(F.lit("fifo_Depth"))).otherwise(F.array(F.lit("x")))
    return t(spark, d, "events").select(F.expr("concat('m.', CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END, user_id, '[', event_id, ']')").alias("hier_path"), fanin.alias("fanin"))


@query("v11_johnson_counters", f"WITH {_ROWS}, n AS (SELECT *, count_if(sync_type <> 'none') OVER (PARTITION BY prefix) AS n FROM x), h AS (SELECT *, sync_type <> 'none' AND user_id % 5 = 0 AND n >= 4 AND n % 2 = 0 AS hit FROM n) SELECT cid, CASE WHEN hit THEN 'johnson_counter' ELSE sync_type END AS sync_type, CASE WHEN hit THEN 'INFO' ELSE 'VIOLATION' END AS category FROM h")
def johnson(spark, d):
    return cdc.verify_johnson(_rows(spark, d), _sources(spark, d)).select("cid", "sync_type", "category")


@query("v12_fifo_depth", f"WITH {_ROWS} SELECT cid, CASE WHEN event_id % 2 = 0 AND user_id % 5 = 1 THEN 'Ac_cdc07' ELSE 'Ac_cdc01' END AS rule FROM x")
def fifo_depth(spark, d):
    return cdc.verify_fifo_depth(_rows(spark, d, "CASE WHEN event_id % 2 = 0 THEN 'async_fifo' ELSE 'two_ff' END"), _sources(spark, d)).select("cid", "rule")


@query(
    "v9_multiplexers",
    """WITH s AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END || user_id || '[' || event_id || ']' AS input, user_id % 3 AS d FROM events WHERE event_id % 2 = 0),
f AS (SELECT event_id, user_id % 3 AS d, event_id % 2 = 0 AS synced, event_id % 3 = 0 AS two, CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END || user_id || '[' || (event_id // 2) || ']' AS input FROM events)
SELECT 'c' || event_id AS cid, CASE WHEN NOT synced THEN 'none' WHEN two AND s.input IS NOT NULL THEN 'mux' ELSE 'two_ff' END AS sync_type FROM f LEFT JOIN s USING (input, d)""",
)
def mux(spark, d):
    select = F.expr("concat(CASE WHEN user_id % 2 = 0 THEN 'wptr' ELSE 'cnt' END, user_id, '[', event_id div 2, ']')")
    ffs = t(spark, d, "events").select(F.expr("concat('q', event_id)").alias("hier_path"), F.when(F.col("event_id") % 3 == 0, F.array(select, F.lit("zz"))).otherwise(F.array(select)).alias("fanin"))
    return cdc.verify_mux(_rows(spark, d), ffs).select("cid", "sync_type")


@query(
    "v5_reset_domains",
    """WITH r AS (SELECT event_id, event_type AS d, event_id // 2 AS f FROM events WHERE event_id % 3 = 0), b AS (SELECT r.event_id, r.f FROM r JOIN events e ON e.event_id = r.f WHERE e.event_type <> r.d),
k AS (SELECT 'r' || f || '>r' || event_id AS pair FROM b)
SELECT 'r' || (event_id // 2) || '>r' || event_id AS pair, CASE WHEN pair IS NULL THEN 'Ac_cdc01' ELSE 'Ac_cdc06' END AS rule FROM events LEFT JOIN k ON pair = 'r' || (event_id // 2) || '>r' || event_id WHERE event_id % 2 = 0
UNION ALL SELECT 'r' || f || '>r' || event_id, 'Ac_cdc06' FROM b WHERE event_id % 2 <> 0""",
)
def resets(spark, d):
    e = t(spark, d, "events")
    ffs = e.select(F.expr("concat('r', event_id)").alias("hier_path"), F.col("event_type").alias("source_id"), F.lit("pos").alias("edge"), F.when(F.col("event_id") % 3 == 0, F.expr("concat('r', event_id div 2)")).alias("reset_path"), (F.col("event_id") % 3 == 0).alias("reset_async"), F.col("event_id").alias("seq"))
    rows = _rows(spark, d, "'none'").withColumn("k", F.substring("cid", 2, 20).cast("long")).where("k % 2 = 0").withColumn("source_signal", F.expr("concat('r', k div 2)")).withColumn("dest_signal", F.expr("concat('r', k)")).drop("k")
    return cdc.verify_resets(rows, ffs).select(F.concat("source_signal", F.lit(">"), "dest_signal").alias("pair"), "rule")


@query(
    "v8_pulses",
    """SELECT 'c' || event_id AS cid, CASE WHEN event_id % 2 <> 0 THEN 'none' WHEN event_id % 4 = 0 THEN 'pulse' ELSE 'two_ff' END AS sync_type FROM events""",
)
def pulses(spark, d):
    """Each crossing has a chain q, a, b; where event_id % 4 = 0 a register z takes a and b, else only b."""
    e = t(spark, d, "events").select("event_id", F.explode(F.array(*map(F.lit, "qabz"))).alias("k"))
    ffs = e.select(F.expr("concat(k, event_id)").alias("hier_path"), F.lit("s").alias("source_id"), F.lit("pos").alias("edge"), F.expr("CASE WHEN k = 'z' THEN array('a', 'b') ELSE array('x') END").alias("fanin"))
    hops = F.expr("CASE WHEN event_id % 4 = 0 THEN array('qa', 'ab', 'bz', 'az') ELSE array('qa', 'ab', 'bz') END")
    edges = t(spark, d, "events").select("event_id", F.explode(hops).alias("h")).select(F.expr("concat(left(h, 1), event_id)").alias("src_path"), F.expr("concat(right(h, 1), event_id)").alias("dst_path"), F.lit(False).alias("has_comb"))
    return cdc.verify_pulse(_rows(spark, d), ffs, edges).select("cid", "sync_type")


@query("j25_unsafe_registers", f"WITH {FFS} SELECT source_id AS source_signal, hier_path AS dest_signal, source_id || ':pos' AS dest_domain FROM ffs WHERE length(source_id) % 2 = 0")
def unsafe(spark, d):
    bad = t(spark, d, "events").where("length(event_type) % 2 = 0").select(F.col("event_type").alias("source_id")).distinct()
    return cdc.unsafe_clock_rows(registers(spark, d), bad).select("source_signal", "dest_signal", "dest_domain")

"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width mismatches by region, nation and severity: supplier drives order net, customer loads it."""
    lineitem, orders, part = (t(spark, sf_dir, x) for x in ("lineitem", "orders", "part"))
    customer, nation, region = (t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    links = (
        lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("dest_width"))
        .join(part.select("p_partkey", F.col("p_size").alias("source_width")), F.col("l_partkey") == F.col("p_partkey"))
        .where("source_width <> dest_width")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    severity = F.when(F.col("source_width") > F.col("dest_width"), "ERROR").otherwise("WARN")
    return links.groupBy("r_name", "n_name", severity.alias("severity")).agg(F.count(F.lit(1)).alias("n_issues"))

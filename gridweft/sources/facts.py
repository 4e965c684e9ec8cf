"""Fact tables and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the fact tables.
SCHEMAS = {
    "instances": "path string, name string, parent_path string, module string, depth int, seq int",
    "ports": "instance_path string, port_name string, direction string, width int, is_signed boolean, is_top boolean, full_path string, seq int",
    "port_bindings": "instance_path string, port_name string, net_key string, is_driver boolean, kind string, seq int",
    "port_state": "full_path string, connected boolean, tie_off boolean, tie_zero boolean",
    "net_aliases": "lhs_key string, rhs_key string, approximate boolean, seq int",
    "clock_sources": "source_id string, name string, type string, origin_signal string, master_id string, period_ns double, divide_by int, multiply_by int, invert boolean, unsafe_comb boolean, seq int",
    "clock_nets": "hier_path string, source_id string, edge string, is_gated boolean, gate_enable string",
    "relationships": "a_id string, b_id string, relationship string, sdc_declared boolean, seq int",
    "ffs": "hier_path string, source_id string, edge string, primitive string, width int, fanin array<string>, reset_path string, reset_async boolean, seq int",
    "ff_edges": "src_path string, dst_path string, has_comb boolean, seq int",
    "transform_nodes": "node_id long, op_kind string, op_detail string, output string, inputs array<string>, bit_width int, approximate boolean",
    "roots": "root_id string, root_kind string, signal string",
    "flip_flops": "name string, q_signal string, d_signal string",
}


def read_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All fact tables of a folder of Parquet files, lazily."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in SCHEMAS.items()}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


CONNECTION_REPORT = "connections array<struct<source:string,dest:string,status:string>>"
METRICS_REPORT = "roots array<struct<root_id:string,root_kind:string,raw:int,depth:int,norm:int>>"


def parse_connections(reports: DataFrame) -> DataFrame:
    """(source, dest, status, seq) from reports in a JSON column ``value``.

    A missing status is OK, rows with an empty end are dropped, and a width range is stripped from
    the port's part of a path alone.
    """
    rows = reports.select(F.posexplode(F.from_json("value", CONNECTION_REPORT)["connections"]).alias("seq", "c"))
    bare = lambda c: F.regexp_replace(F.col(f"c.{c}"), r"\[[0-9]+:[0-9]+\]$", "")
    return rows.select(bare("source").alias("source"), bare("dest").alias("dest"), F.coalesce("c.status", F.lit("OK")).alias("status"), "seq").where("source <> '' AND dest <> ''")


def parse_roots(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode(F.from_json("value", METRICS_REPORT)["roots"]).alias("r")).select("r.*")


def read_baseline(spark: SparkSession, path: str, kind: str = "connections", lines: bool = False) -> DataFrame:
    """Connections or roots of a report; with lines, of one that ``sinks.reports`` wrote, a row on each line."""
    if lines:
        # only rows of the wanted list have these as their first columns
        first = '^[ ,]\\{"source":.*"status":' if kind == "connections" else '^[ ,]\\{"root_kind":|^[ ,]\\{"root_id":'
        one = F.concat(F.lit(f'{{"{kind}":['), F.expr("substr(value, 2)"), F.lit("]}"))
        rows = spark.read.text(path).where(F.col("value").rlike(first)).select(one.alias("value"))
    else:
        rows = spark.read.text(path, wholetext=True)
    return parse_connections(rows) if kind == "connections" else parse_roots(rows)

"""Shared plumbing of the operators: tables, scratch files and the folds of the labels."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is named, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridweft-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gridweft-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table written to the shared scratch folder.

    This cuts the lineage and survives lost executors; unlike persisted blocks, later reads take
    only the columns they need. The folder is scratch space that the cluster empties.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the held-out folds of the labels."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """Whether a row teaches nothing; a row without an id is in no fold and does not teach either."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(True)).alias("held_out")


def clear_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def bounded_sample(df: DataFrame, bound: int, count: int, key: str = "doc_id") -> DataFrame:
    """About ``bound`` of ``count`` rows, chosen by a hash of the key; all when there are no more."""
    if count <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 30)) < int((1 << 30) * bound / count))

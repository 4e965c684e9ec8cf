"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft.llm.common import clear_text, stored, table

#: Characters of the normalised text under the prefix hash.
PREFIX_CHARS = 64


def normalised(text: str = "text") -> Column:
    """The text with each run of blanks replaced by one space; null counts as empty."""
    return F.regexp_replace(clear_text(text), r"[\x20\x09-\x0D]+", " ")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, prefix_hash and text_sha256 of every row, stored column by column.

    The text is read once and never shuffled: hashing it in that scan costs less than moving the
    texts of surviving groups to a second one.
    """
    flat = docs.select("doc_id", normalised().alias("flat"))
    out = flat.select(
        "doc_id",
        F.octet_length("flat").cast("long").alias("n_bytes"),
        F.xxhash64(F.substring("flat", 1, PREFIX_CHARS)).alias("prefix_hash"),
        F.sha2("flat", 256).alias("text_sha256"),
    )
    return stored(out, "fingerprints")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal normalised texts form a group. Its row with the smallest doc_id stays; of rows
    that share that doc_id too one stays, and a null doc_id comes after all others (keep_id is null
    where a group has no other). Three rounds narrow the rows down: a length that others share,
    then a prefix hash that others share, and only what survives both has its full hash read and
    grouped. All rounds work on stored narrow columns; hot groups meet only partial aggregates and
    joins that can be split.

    Null and empty texts are one group; long texts are hashed whole. An empty table gives an empty
    result; columns other than doc_id and text are ignored, whatever their names.
    """
    rows = fingerprints(docs)
    # partial aggregates fold copies before anything is shuffled
    prefixes = rows.groupBy("n_bytes", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))
    # stored, so that the join after a final aggregate has exchanges that can be split
    by_prefix = stored(_shared(prefixes), "prefixes")
    same_prefix = rows.join(by_prefix, ["n_bytes", "prefix_hash"], "left_semi")
    # rows that repeat doc_id and text fold first; first: the smallest doc_id and how many rows have it
    repeats = same_prefix.groupBy("n_bytes", "text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "n"))
    groups = stored(
        repeats.groupBy("n_bytes", "text_sha256")
        .agg(first.alias("first"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
        .select("n_bytes", "text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.n").alias("n_first"), "group_size"),
        "groups",
    )
    found = rows.select("doc_id", "n_bytes", "text_sha256").join(groups, ["n_bytes", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    out = found.where(alone | ~is_first | (F.col("n_first") == 1)).select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size, (alone | is_first).alias("kept"), "text_sha256")
    # of several first rows, which nothing tells apart, one is kept
    several = groups.where("n_first > 1").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_first"))).alias("k"))
    return out.unionAll(several.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("k") == 1).alias("kept"), "text_sha256"))


def _shared(prefixes: DataFrame) -> DataFrame:
    """The (n_bytes, prefix_hash) of several rows: lengths that others share first, then prefixes."""
    by_length = prefixes.groupBy("n_bytes").agg(F.sum("n").alias("n_length")).where("n_length > 1")
    return prefixes.join(by_length, "n_bytes", "left_semi").where("n > 1").select("n_bytes", "prefix_hash")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal normalised texts, with all its columns: that of the smallest doc_id.

    Rows are told apart by their texts, never by doc_id, so that ids may repeat or be null (null
    ids come last). Lengths and prefix hashes are taken in a first scan; rows that share neither
    go straight to the output, and only the others' full hashes are computed. Rows of a group fold
    within each task before they are shuffled. Null and empty texts are one group; an empty table
    stays empty; other columns may have any names.
    """
    flat = normalised()
    length, prefix = F.octet_length(flat).cast("long"), F.xxhash64(F.substring(flat, 1, PREFIX_CHARS))
    light = docs.select(length.alias("n_bytes"), prefix.alias("prefix_hash"))
    shared = stored(_shared(light.groupBy("n_bytes", "prefix_hash").agg(F.count(F.lit(1)).alias("n"))), "prefixes")
    row = docs.select(F.struct(*docs.columns).alias("row"), length.alias("n_bytes"), prefix.alias("prefix_hash"))
    alone = row.join(shared, ["n_bytes", "prefix_hash"], "left_anti").select("row")
    others = row.join(shared, ["n_bytes", "prefix_hash"], "left_semi").select("row", F.sha2(normalised("row.text"), 256).alias("hash"))
    first = others.groupBy("hash").agg(F.min_by("row", F.struct(F.col("row.doc_id").isNull().alias("null"), "row.doc_id")).alias("row"))
    return alone.unionAll(first.select("row")).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH flat AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM flat
"""

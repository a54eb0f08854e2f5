"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries summary (Spark's mergeable approx_top_k) names the digests that may hold a large share of the rows.
An exact count over just these verifies them; the verified winners, at most HEAVY rows, are broadcast and label their
rows map-side. Every other digest occurs in fewer than about 4/TRACKED of the rows, so that the ordinary shuffle by
digest has no large group.

Nulls: a null text counts as empty; a null doc_id never wins over another, and is kept if all of a group's are null.
Rows that share a doc_id stay separate rows; kept goes by doc_id. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import ascii_lower, cut, table, without_rows

HEAVY, TRACKED = 1000, 10000


def text_digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def _labelled(rows: DataFrame, best: DataFrame) -> DataFrame:
    """rows: doc_id, digest. best: digest, keep_id, group_size."""
    return rows.join(best, "digest")


def exact_groups(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, digest (binary), keep_id, group_size."""
    rows = cut(docs.select("doc_id", F.unhex(text_digest(F.col("text"))).alias("digest")))
    # a 64-bit prefix names a candidate; verification below groups by the whole digest
    prefix = F.xxhash64("digest")
    named = (
        rows.select(prefix.alias("prefix"))
        .agg(F.expr(f"approx_top_k(prefix, {heavy}, {tracked})").alias("top"))
        .select(F.explode("top").alias("t"))
        .filter(F.col("t.count") > 1)
        .select(F.col("t.item").alias("prefix"))
    )
    named = cut(named)
    winners = (
        rows.withColumn("prefix", prefix)
        .join(F.broadcast(named), "prefix", "left_semi")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    winners = cut(winners)
    known = F.broadcast(winners)
    map_side = _labelled(rows, known)
    by_digest = Window.partitionBy("digest")
    rest = rows.join(known, "digest", "left_anti").select(
        "doc_id",
        "digest",
        F.max("doc_id").over(by_digest).alias("keep_id"),
        F.count(F.lit(1)).over(by_digest).alias("group_size"),
    )
    return map_side.select(*rest.columns).unionByName(rest)


def exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays; of wholly repeated rows, one. Rows are told apart by
    doc_id and text."""
    judged = exact_groups(docs).select("doc_id", F.col("digest").alias("row"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    return without_rows(docs, judged, F.unhex(text_digest(F.col("text"))))


ORACLE = f"""
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

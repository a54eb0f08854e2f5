"""Corpus preparation: completeness, first-wins dedup, reproducible shuffle, split and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import md5_order, truthy
from loomline.sources.tables import cut


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in columns:
        rows = rows.filter(truthy(F.col(c)))
    return rows


def dedup_key(*columns: str, separator: str = "") -> Column:
    """Without a separator "ab" + "c" equals "a" + "bc", as the original tools have it."""
    return F.concat_ws(separator, *columns)


def first_wins(rows: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """Of rows with one key, the first in order. Aggregates before the shuffle, so a key that a third of the rows have
    costs a row per task."""
    columns = rows.columns
    best = rows.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def shuffled(rows: DataFrame, *keys: str, seed: int = 42) -> DataFrame:
    return rows.orderBy(md5_order(*keys, seed=seed), *keys)


def ranked(rows: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """Places from 1 on by a total order, over all tasks: each range of the order counts its own rows, and the places
    start where the ranges before it end. The ranges are written first, so that both passes see the same ones."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("__k", F.struct(*order))
    ranged = cut(keyed.repartitionByRange(parts, "__k").withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__k"))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per task
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(into, (F.col("__before") + F.col("__own")).cast("long")).drop("__k", "__part", "__own", "__before")


def train_val(rows: DataFrame, *keys: str, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds split: the first max(1, floor(n * ratio)) rows of the shuffle are val, the others train."""
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    order = [md5_order(*keys, seed=seed).alias("h"), *[F.col(k) for k in keys]]
    placed = ranked(rows, order).crossJoin(F.broadcast(total))  # one row
    val = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(ratio)))
    return placed.withColumn("split", F.when(F.col("rank") <= val, F.lit("val")).otherwise(F.lit("train"))).drop("__total")


def sample(rows: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for every model that is compared."""
    return rows.orderBy(md5_order(*keys, seed=seed), *keys).limit(n)

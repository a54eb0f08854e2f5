"""The incremental mode: chapters arrive as files, extraction records append to a table, a rerun continues.

A chapter that is in the table already is not taken again, whatever order chapters come in, and a chapter that failed is
retried on the next run (the original resumes after the highest chapter and never retries one below it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators.extraction import EXTRACTION

DELTAS = f"doc_id string, seq bigint, chapter int, extraction {EXTRACTION}"


def pending(chapters: DataFrame, deltas: DataFrame, strict: bool = False) -> DataFrame:
    """Chapters still to extract: those not in deltas. strict: those after the highest one, as the original resumes."""
    if strict:
        last = deltas.groupBy("doc_id").agg(F.max("chapter").alias("last"))
        return chapters.join(last, "doc_id", "left").filter(F.col("index") > F.coalesce("last", F.lit(0))).drop("last")
    done = deltas.select("doc_id", F.col("chapter").alias("index")).distinct()
    return chapters.join(done, ["doc_id", "index"], "left_anti")


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """The table of deltas, empty where there is none yet. A record delivered twice counts once."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], DELTAS)
    rows = spark.read.schema(DELTAS).parquet(path)
    return rows.groupBy("doc_id", "seq").agg(F.min_by(F.struct("chapter", "extraction"), "chapter").alias("r")).select("doc_id", "seq", "r.*")


def stream_deltas(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends every new JSON file under source to the table and stops when all are in."""
    records = spark.readStream.schema(DELTAS).json(source)
    return records.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_first_wins(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends JSON records, the first of each key alone; state is kept per key by the stream itself."""
    rows = spark.readStream.schema(schema).json(source).dropDuplicates(keys)
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_day_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """events (a stream: ts, user_id, event_type): counts per day, user and kind, late rows within the delay included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "user_id", "event_type").count()

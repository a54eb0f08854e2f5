"""What the operators of this subpackage share: tables, durable cuts, byte views of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.tables import cut, drop, shared_dir, together

__all__ = [
    "ascii_lower", "cut", "drop", "few_sent", "grams", "mix", "padded", "partitions", "prefix_hash", "random_table", "separated", "shared_dir", "small_batches", "table", "text_views", "together", "without_rows",
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch sent to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 512
#: Rows that a side of a join may have to be broadcast; a larger one is shuffled.
MOST_SENT = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; null is empty. Texts of ASCII alone take the fast path."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def separated(column: str) -> Column:
    """A text as bytes that end in a space, null as empty."""
    return F.concat(F.coalesce(F.col(column), F.lit("")), F.lit(" ")).cast("binary").alias(column)


def padded(batch: pa.RecordBatch, column: str, before: str, after: str) -> pa.RecordBatch:
    """A batch of the column alone, as bytes, with something before and after each text; null is empty. The padding is
    put on in the worker, so that a text travels there once."""
    text = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    whole = pc.binary_join_element_wise(pa.scalar(before.encode(), pa.large_binary()), text, pa.scalar(after.encode(), pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return pa.RecordBatch.from_arrays([whole], [column])


def few_sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """rows, to be broadcast if they were counted to be few; else the join shuffles. rows must be cut (they are counted)."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def without_rows(docs: DataFrame, judged: DataFrame, row: Column) -> DataFrame:
    """docs less the rows that do not stay. judged: doc_id, row (an expression over docs that tells rows of one doc_id
    apart), stays, one for each row of docs. What goes is looked up, not what stays; of wholly repeated rows that stay
    one is left."""
    told = judged.groupBy(F.col("doc_id").alias("__loom_id"), F.col("row").alias("__loom_row")).agg(F.max("stays").alias("__loom_stays"), F.count(F.lit(1)).alias("__loom_times"))
    told = cut(told.filter("not __loom_stays or __loom_times > 1"))
    same = F.col("doc_id").eqNullSafe(F.col("__loom_id")) & (row == F.col("__loom_row"))
    left = docs.join(few_sent(told), same, "left_anti")
    repeated = told.filter("__loom_stays")
    if repeated.isEmpty():
        return left
    once = docs.withColumn("__loom_key", row).join(repeated, F.col("doc_id").eqNullSafe(F.col("__loom_id")) & (F.col("__loom_key") == F.col("__loom_row")))
    return left.unionByName(once.dropDuplicates(["__loom_id", "__loom_row"]).select(*docs.columns))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_views(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows whose UTF-8 texts take about limit bytes together (a longer text stands alone): first row, end row,
    bytes, offsets of the rows in them (one more than rows). Null is empty. The bytes are a view, not a copy."""
    texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def prefix_hash(data: np.ndarray, table_: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of table_[byte] * base**i (mod 2**64) and powers of base's inverse: the hash of data[s:e], wherever
    it stands, is (sums[e] - sums[s]) * inverse[s]."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    terms = table_[data]
    terms *= _powers(base, n)
    np.cumsum(terms, out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), n + 1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def random_table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SALTS = random_table(12, 8)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size words (at most 8)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k : k + n] * _SALTS[k]
    return mix(total + np.uint64(size))

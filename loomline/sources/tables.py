"""Durable cuts of lineage: a table in the shared folder, read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which the shuffle files behind a finished query go at once.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whether partitions after a shuffle are kept as many as cores, or merged up to the advisory size.
SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if driver and executors are one process;
    on a cluster executors would each write to a disk of their own, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs
    only the tasks it held. The shuffle files behind df go with the write; the table goes when the application ends, or
    earlier by drop(). few: for small tables of little work; what a shuffle made is written to as few files as the
    advisory size allows, since on a local file system without Hadoop's native library each file costs several processes."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with _set(spark, **{TIDY: "true"}, **({SPREAD: "false"} if few else {})):
        df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables that cut() wrote, of one schema, as one scan."""
    paths = sorted(set().union(*map(_folders, tables)))
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*paths) if paths else tables[0]


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() wrote, once nothing will read it again."""
    spark = df.sparkSession
    for path in _folders(df):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getName().startswith("cut-"):
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)

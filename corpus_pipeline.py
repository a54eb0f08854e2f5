"""The corpus pipeline: five stages from raw documents to packed training sequences, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontamination, exact_dedup, language, packing, simhash
from loomline.llm.common import cut, table

STAGES = [
    ("language", language.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: Learned models, XXH64 and tokenizer ids are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

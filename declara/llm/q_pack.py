"""Query op4: no SQL can tokenize, so tests hold it against the tokenizer itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pack import pack


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

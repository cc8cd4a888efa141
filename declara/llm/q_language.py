"""Query op7. Tests hold it against held-out labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import identify


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(fold() != 2).select("doc_id", "text", "lang"))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")

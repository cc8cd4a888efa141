"""Query op10. Gamma samples are not SQL; tests hold it against a plain version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprint import fingerprints


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

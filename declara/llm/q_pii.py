"""Query op3. Keyed surrogates are not SQL; tests hold it against a plain search and replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pii import pseudonymise

#: The setting that names the key; what stands in for it where none is set is no secret.
KEY_SETTING, NO_KEY = "spark.declara.pii.key", "not a secret"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, NO_KEY))

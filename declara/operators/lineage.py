"""What procedures, functions, tasks and streams read and write, and what sidecar files say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as S


def lineage(found: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(object_fqn, file_path, sources, targets, description, auto_detected); declared sides win where given.

    A sidecar speaks for the file's objects that read or write something, else for
    its last object, else for one named after the file.
    """
    none = F.array().cast("array<string>")
    auto = found.where(~F.col("is_drop") & ((F.size("sources") > 0) | (F.size("targets") > 0))).select(F.col("fqn").alias("object_fqn"), "file_path", "sources", "targets")
    if declared is None:
        return auto.withColumn("description", F.lit("")).withColumn("auto_detected", F.lit(True))
    told = declared.select("file_path", F.col("sources").alias("ds"), F.col("targets").alias("dt"), F.col("description").alias("dd"))
    owners = found.where(~F.col("is_drop")).groupBy("file_path").agg(F.max_by("fqn", "line_number").alias("owner"))
    both = auto.join(told, "file_path", "full_outer").join(owners, "file_path", "left")
    either = lambda a, b: F.when(F.size(F.coalesce(a, none)) > 0, a).otherwise(F.coalesce(b, none))
    return both.select(
        F.coalesce("object_fqn", "owner", F.upper(S.path_stem(F.col("file_path")))).alias("object_fqn"),
        "file_path",
        either(F.col("ds"), F.col("sources")).alias("sources"),
        either(F.col("dt"), F.col("targets")).alias("targets"),
        F.coalesce("dd", F.lit("")).alias("description"),
        F.col("ds").isNull().alias("auto_detected"),
    )

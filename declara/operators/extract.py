"""Objects that a SQL corpus defines, with dependencies, columns, lineage and policy violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as S
from ..functions.analysis import MUST_ALTER, OBJECT, objects_udf
from ..sources.project import there
from .tables import settled

#: What ``violations`` reads.
JUDGED = ("form", "object_type", "fqn", "is_drop", "source_line", "line_number")
OUT = ("file_path", *OBJECT.names, "raw_sql", "resolved_sql", "checksum")


def objects(corpus: DataFrame, variables: dict[str, str] | None = None, only: tuple[str, ...] = tuple(OBJECT.names), named: str = ".*") -> DataFrame:
    """A row for each CREATE and DROP; a file without one is a SCRIPT named after it.

    ``checksum`` is the file's; ``script`` what is to be run for this object alone.
    With ``only``, the parse makes no other columns of OBJECT than these; with ``named``,
    a regular expression of Python, only objects whose whole ``raw_name`` it matches.
    """
    files = corpus.withColumn("resolved_sql", S.substituted(F.col("raw_sql"), variables or {}))
    return files.withColumn("o", F.explode(objects_udf(only, named)("resolved_sql", "file_path"))).select("*", "o.*").select(*(c for c in OUT if c in only or c not in OBJECT.names))


def cached_objects(corpus: DataFrame, variables: dict[str, str] | None, cache: str) -> DataFrame:
    """The same, but files are parsed only if the cache (a Parquet folder) has none of their path, checksum and variables.

    What is parsed is added to the cache; rows of files that are gone stay there until someone removes the folder.
    """
    spark = corpus.sparkSession
    key = F.md5(F.concat_ws("\x1f", "file_path", "checksum", F.lit(repr(sorted((variables or {}).items())))).cast("binary"))
    files = settled(corpus.withColumn("cache_key", key))
    new = files
    if there(spark, cache):
        new = files.join(spark.read.parquet(cache).select("cache_key").distinct(), "cache_key", "left_anti")
    fresh = settled(objects(new, variables).withColumn("cache_key", key))
    if not fresh.isEmpty() or not there(spark, cache):
        fresh.write.mode("append").parquet(cache)
    return spark.read.schema(fresh.schema).parquet(cache).join(files.select("cache_key"), "cache_key", "left_semi").select(*OUT)


def current(found: DataFrame) -> DataFrame:
    """One definition of each name: the last by path and place."""
    last = F.row_number().over(Window.partitionBy("fqn").orderBy(F.desc("file_path"), F.desc("line_number")))  # columns that no one reads are not carried
    return found.where(~F.col("is_drop")).withColumn("_place", last).where("_place = 1").drop("_place")


def shadowed(found: DataFrame) -> DataFrame:
    """(fqn, file_path) of definitions that a later file replaces."""
    kept = current(found).select("fqn", F.col("file_path").alias("kept_path"))
    return found.where(~F.col("is_drop")).join(kept, "fqn").where("file_path <> kept_path").select("fqn", "file_path", "kept_path")


def violations(found: DataFrame) -> DataFrame:
    """Objects of types that must be CREATE OR ALTER and are not, with the line of the statement."""
    bad = found.where(~F.col("is_drop") & F.col("object_type").isin(MUST_ALTER) & (F.col("form") != "OR ALTER"))
    shown = F.concat_ws(" ", F.lit("CREATE"), F.nullif(F.col("form"), F.lit("")))
    return bad.select("file_path", "object_type", "fqn", shown.alias("found_form"), F.lit("CREATE OR ALTER").alias("suggested_form"), "source_line", "line_number")

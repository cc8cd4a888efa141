"""What the session's catalog and the registry hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import Registry

RESOURCE = "schema string, type string, name string, fqn string, created_on string, owner string, comment string"
VERIFIABLE = ("TABLE", "VIEW", "FUNCTION", "SCHEMA")


def is_shown(schema: Column) -> Column:
    return F.upper(schema) != "INFORMATION_SCHEMA"


def unsigned(name: Column) -> Column:
    """A function's name without its signature."""
    return F.substring_index(name, "(", 1)


def resources(spark: SparkSession) -> DataFrame:
    """Schemas, tables, views and functions of the catalog, but for INFORMATION_SCHEMA, and what is only recorded."""
    rows = []
    for db in spark.catalog.listDatabases():
        rows.append((db.name, "SCHEMA", db.name, db.name.upper(), "", "", db.description or ""))
        for t in spark.catalog.listTables(db.name):
            if not t.isTemporary:
                kind = "VIEW" if "VIEW" in t.tableType else "TABLE"
                rows.append((db.name, kind, t.name, f"{db.name}.{t.name}".upper(), "", "", t.description or ""))
        for f in spark.catalog.listFunctions(db.name):
            if not f.isTemporary and f.namespace:
                name = f.name.split(".")[-1]
                rows.append((db.name, "FUNCTION", name, f"{db.name}.{name}".upper(), "", "", f.description or ""))
    told = spark.createDataFrame(rows, RESOURCE).where(is_shown(F.col("schema"))).withColumn("name", unsigned(F.col("name"))).withColumn("fqn", unsigned(F.col("fqn")))
    kept = Registry(spark).rows().where(~F.col("kind").startswith("USE") & ~F.col("kind").startswith("DROP") & ~F.col("kind").isin("GRANT", "REVOKE", "COMMENT"))
    parts = F.split("name", r"\.")
    recorded = kept.select(
        F.when(F.size(parts) > 1, F.lower(F.get(parts, F.size(parts) - 2))).otherwise("").alias("schema"), F.col("kind").alias("type"), F.element_at(parts, -1).alias("name"), F.col("name").alias("fqn"),
        F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("created_on"), F.lit("").alias("owner"), F.lit("").alias("comment"),
    )
    return told.unionByName(recorded)


def _keys(name: Column) -> Column:
    """What an object can be found by: schema and name, and the name alone."""
    return F.array_distinct(F.array(F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)))


def missing(spark: SparkSession, objects: DataFrame) -> DataFrame:
    """(fqn) objects of kinds that can be verified and are not in the catalog."""
    there = resources(spark).select("type", F.explode(_keys(F.col("fqn"))).alias("key")).distinct()
    asked = objects.where(F.col("object_type").isin(*VERIFIABLE)).select("fqn", F.col("object_type").alias("type"), F.substring_index("fqn", ".", -2).alias("key"))
    return asked.join(there, ["type", "key"], "left_anti").select("fqn")


def with_local(found: DataFrame, objects: DataFrame) -> DataFrame:
    """Resources with ``is_local``: whether the project defines them, in any case and with or without a database."""
    own = objects.select(F.explode(F.array_distinct(F.array(F.upper("fqn"), F.upper(F.substring_index("fqn", ".", -2))))).alias("key")).distinct().withColumn("hit", F.lit(True))
    return found.join(own, F.upper(found.fqn) == own.key, "left").select(*found.columns, F.col("hit").isNotNull().alias("is_local"))


def object_columns(spark: SparkSession, schema: str) -> DataFrame:
    """(fqn, columns array<struct<name, type>>) of a schema's tables, by catalog, schema and name, and without the catalog."""
    top = spark.catalog.currentCatalog()
    rows = [(f"{top}.{schema}.{t.name}".upper(), i, c.name, c.dataType) for t in spark.catalog.listTables(schema) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(f"{schema}.{t.name}"))]
    return grouped_columns(spark.createDataFrame(rows, "fqn string, pos int, name string, type string"))


def grouped_columns(rows: DataFrame) -> DataFrame:
    """(fqn, columns) of rows (fqn of three parts, pos, name, type): each object under its three-part and its two-part name."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))), lambda c: F.struct(c["name"], c["type"]))
    whole = rows.groupBy("fqn").agg(listed.alias("columns"))
    return whole.select(F.explode(F.array_distinct(F.array("fqn", F.regexp_replace("fqn", r"^[^.]*\.(?=[^.]+\.)", "")))).alias("fqn"), "columns")


def tree(found: DataFrame, *levels: str) -> DataFrame:
    """Counts at each level (by default schema and type), and the names at the lowest."""
    levels = levels or ("schema", "type")
    names = F.when(F.grouping_id() == 0, F.array_sort(F.collect_list("name")))
    return found.rollup(*levels).agg(F.count("*").alias("n"), names.alias("names"))

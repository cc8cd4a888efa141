"""History, lineage and lifecycle of objects as tables, and their maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept_table, settled

HISTORY = "id long, object_fqn string, object_type string, file_path string, checksum string, status string, deployed_at timestamp, deployed_by string, error_message string, executed_sql string"
LINEAGE = "id long, object_fqn string, object_type string, edge_type string, related_fqn string, file_path string, description string, recorded_at timestamp, recorded_by string"
LIFECYCLE = "object_fqn string, object_type string, file_path string, first_deployed_at timestamp, last_deployed_at timestamp, retired_at timestamp, retired_reason string, status string"


def latest(history: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key: a maximum of structs, which combines before the shuffle as a window would not."""
    rest = [c for c in history.columns if c != key]
    ranked = F.max_by(F.struct(*rest), F.struct(*order))
    return history.groupBy(key).agg(ranked.alias("r")).select(key, "r.*").select(*history.columns)


def latest_success(history: DataFrame) -> DataFrame:
    return latest(succeeded(history), "object_fqn", F.col("deployed_at"), F.col("id"))


def changed(current: DataFrame, last: DataFrame, key: str = "fqn") -> DataFrame:
    """Rows of ``current`` whose checksum is not the last one (or that had none)."""
    old = last.select(F.col(last.columns[0]).alias(key), F.col("checksum").alias("old_checksum"))
    return current.join(old, key, "left").where(~F.col("checksum").eqNullSafe(F.col("old_checksum"))).drop("old_checksum")


def upsert(lifecycle: DataFrame, deployed: DataFrame, now: Column) -> DataFrame:
    """deployed: (object_fqn, object_type, file_path). Matched rows are renewed and active again; others are added."""
    new = deployed.select("object_fqn", F.col("object_type").alias("nt"), F.col("file_path").alias("np"), F.lit(True).alias("hit"))
    both = lifecycle.join(new, "object_fqn", "full_outer")
    hit = F.col("hit").isNotNull()
    either = lambda a, b: F.when(hit, F.col(a)).otherwise(F.col(b))
    blank = lambda c: F.when(~hit, F.col(c))
    return both.select(
        "object_fqn", either("nt", "object_type").alias("object_type"), either("np", "file_path").alias("file_path"), F.coalesce("first_deployed_at", now).alias("first_deployed_at"),
        F.when(hit, now).otherwise(F.col("last_deployed_at")).alias("last_deployed_at"), blank("retired_at").alias("retired_at"), blank("retired_reason").alias("retired_reason"),
        F.when(hit, "ACTIVE").otherwise(F.col("status")).alias("status"),
    )


def retire(lifecycle: DataFrame, gone: DataFrame, reason: str, now: Column) -> DataFrame:
    """Active rows among ``gone``(object_fqn) become RETIRED."""
    marked = lifecycle.join(gone.select("object_fqn", F.lit(True).alias("gone")).distinct(), "object_fqn", "left")
    go = F.col("gone").isNotNull() & (F.col("status") == "ACTIVE")
    return marked.select(
        "object_fqn", "object_type", "file_path", "first_deployed_at", "last_deployed_at", F.when(go, now).otherwise(F.col("retired_at")).alias("retired_at"),
        F.when(go, F.lit(reason)).otherwise(F.col("retired_reason")).alias("retired_reason"), F.when(go, "RETIRED").otherwise(F.col("status")).alias("status"),
    )


def removed(lifecycle: DataFrame, current: DataFrame, dropped: DataFrame) -> DataFrame:
    """Active objects that no file defines or drops any more."""
    active = lifecycle.where("status = 'ACTIVE'").select("object_fqn")
    out = active
    for known in (current, dropped):
        out = out.join(known.select(F.col("fqn").alias("object_fqn")), "object_fqn", "left_anti")
    return out


class Store:
    """The three tables, in a schema of the catalog."""

    def __init__(self, spark: SparkSession, schema: str = "declara_state"):
        self.spark, self.schema = spark, schema
        for name, columns in (("deploy_history", HISTORY), ("object_lineage", LINEAGE), ("object_lifecycle", LIFECYCLE)):
            kept_table(spark, schema, name, columns)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.schema}.{name}")

    def replace(self, name: str, df: DataFrame) -> None:
        """Overwrite, from a settled copy: the new rows may come from the old ones."""
        settled(df).write.mode("overwrite").insertInto(f"{self.schema}.{name}")

    def record(self, rows: list[tuple]) -> None:
        """rows: (fqn, type, path, checksum, status, error, sql); errors are cut at 5000 characters."""
        given = self.spark.createDataFrame(rows, "object_fqn string, object_type string, file_path string, checksum string, status string, error_message string, executed_sql string")
        start = self.read("deploy_history").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        out = given.select(
            (F.monotonically_increasing_id() + start + 1).alias("id"), "object_fqn", "object_type", "file_path", "checksum", "status", F.current_timestamp().alias("deployed_at"),
            F.current_user().alias("deployed_by"), F.substring("error_message", 1, 5000).alias("error_message"), "executed_sql",
        )
        out.coalesce(1).write.insertInto(f"{self.schema}.deploy_history")

    def snapshot(self, edges: DataFrame) -> None:
        """Replaces the lineage table by the edges (source, target, type, object_type; file_path and description, where they are there)."""
        given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in edges.columns else F.lit("")
        self.replace(
            "object_lineage",
            edges.select(
                F.monotonically_increasing_id().alias("id"), F.col("source").alias("object_fqn"), "object_type", F.upper("type").alias("edge_type"), F.col("target").alias("related_fqn"),
                given("file_path").alias("file_path"), given("description").alias("description"), F.current_timestamp().alias("recorded_at"), F.current_user().alias("recorded_by"),
            ),
        )

    def lineage(self) -> DataFrame:
        """The stored edges by object: (source, target, type, object_type, file_path, description)."""
        return edges_of(self.read("object_lineage").orderBy("object_fqn", "related_fqn", "edge_type"))

    def known(self) -> DataFrame:
        """(fqn, object_type) of everything that was ever deployed, as of its last success."""
        return latest_success(self.read("deploy_history")).select(F.col("object_fqn").alias("fqn"), "object_type")


def edges_of(rows: DataFrame) -> DataFrame:
    """Rows of the lineage table as edges."""
    return rows.select(F.col("object_fqn").alias("source"), F.col("related_fqn").alias("target"), F.lower("edge_type").alias("type"), "object_type", "file_path", "description")


def listing(history: DataFrame, most: int = 20) -> DataFrame:
    """The last records, newest first."""
    return history.orderBy(F.desc("deployed_at"), F.desc("id")).limit(most)


def succeeded(history: DataFrame) -> DataFrame:
    return history.where("status = 'SUCCESS'")

"""What a project declares that Spark has no objects for: a table of statements, the last of each name counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest
from ..operators.tables import kept_table

COLUMNS = "kind string, name string, statement string, recorded_at timestamp"


class Registry:
    def __init__(self, spark: SparkSession, schema: str = "declara_state"):
        self.spark, self.table = spark, f"{schema}.registry"
        kept_table(spark, schema, "registry", COLUMNS)

    def add(self, kind: str, name: str, statement: str) -> None:
        row = self.spark.createDataFrame([(kind, name.upper(), statement)], "kind string, name string, statement string")
        row.withColumn("recorded_at", F.current_timestamp()).coalesce(1).write.insertInto(self.table)

    def rows(self) -> DataFrame:
        """The last statement of each kind and name."""
        named = self.spark.table(self.table).withColumn("key", F.concat_ws(" ", "kind", "name"))
        return latest(named, "key", F.col("recorded_at")).drop("key")

    def find(self, kind: str, name: str) -> str | None:
        """The statement that a name, with or without its schema, was recorded with."""
        short = name.upper().split(".")[-1]
        told = self.rows().where((F.col("kind") == kind) & ((F.col("name") == name.upper()) | (F.substring_index("name", ".", -1) == short))).orderBy(F.col("name") != name.upper()).first()
        return told["statement"] if told else None

    def place(self, stage: str) -> str:
        """The folder that @stage/path names, by the URL that the stage was created with."""
        import re

        name, _, rest = stage.lstrip("@").partition("/")
        statement = self.find("STAGE", name) or ""
        if not (m := re.search(r"(?i)\bURL\s*=\s*'([^']+)'", statement)):
            raise ValueError(f"no stage {name} with a URL is recorded")
        return m[1].rstrip("/") + ("/" + rest if rest else "")

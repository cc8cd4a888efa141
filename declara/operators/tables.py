"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[weakref.ref, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only in local mode where none is set."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if (app := spark.sparkContext.applicationId) not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="declara-")
    return _own[app]


def place(spark: SparkSession, schema: str, name: str) -> str:
    """Where a table of a schema is kept, by its name, so that files outlive a catalog that is gone with its session."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    return f"{spark.catalog.getDatabase(schema).locationUri.rstrip('/')}/{name.lower()}"


def kept_table(spark: SparkSession, schema: str, name: str, columns: str) -> None:
    """A Parquet table at its place, with the rows that are there."""
    at = place(spark, schema, name).replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}) USING parquet LOCATION '{at}'")


def _write(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    _written.append((weakref.ref(df.sparkSession), path))
    df.write.parquet(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame) -> DataFrame:
    """Written and read again: cuts the plan between rounds, and survives lost executors. Goes when the driver ends."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt over many tasks by keys: readers deal by bytes, which leaves rows that take long in one task where they are short."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


class Rounds:
    """What the rounds of a loop add, each written once and read together; gone when the loop has its result."""

    def __init__(self):
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of this round alone."""
        self.paths.append(_write(df))
        self.spark, self.schema = df.sparkSession, df.schema
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def result(self, df: DataFrame | None = None, *others: Rounds) -> DataFrame:
        """``df`` (by default all rows) as a table of its own; the rounds' tables are removed."""
        out = settled(self.all() if df is None else df)
        for rounds in (self, *others):
            for path in rounds.paths:
                _delete(out.sparkSession, path)
        return out


def release() -> None:
    """Remove every table that is left."""
    while _written:
        ref, path = _written.pop()
        try:
            _delete(ref(), path)
        except Exception:  # the session is gone; the folder's owner cleans up
            continue


atexit.register(release)

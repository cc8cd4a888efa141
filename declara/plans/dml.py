"""UPDATE, DELETE, MERGE and COPY on tables of files: the new rows are written aside, then over the old ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import settled


class Table(NamedTuple):
    name: str
    alias: str


class Ambiguous(ValueError):
    """A row that a MERGE would change more than once."""


def _replace(spark: SparkSession, table: Table, rows: DataFrame) -> None:
    aside = settled(rows)
    aside.write.mode("overwrite").insertInto(table.name)
    spark.catalog.refreshTable(table.name)


def _cast(expression: str, column) -> str:
    return f"CAST(({expression}) AS {column.dataType.simpleString()}) AS `{column.name}`"


def deleted(spark: SparkSession, table: Table, where: str) -> None:
    """Rows for which the condition is true go."""
    _replace(spark, table, spark.sql(f"SELECT * FROM {table.name} AS {table.alias} WHERE NOT ({where}) OR ({where}) IS NULL"))


def updated(spark: SparkSession, table: Table, changes: dict[str, str], where: str) -> None:
    schema = spark.table(table.name).schema
    unknown = set(changes) - {c.name.upper() for c in schema}
    if unknown:
        raise ValueError(f"{table.name} has no column {', '.join(sorted(unknown))}")
    new = ", ".join(_cast(changes[c.name.upper()], c) if c.name.upper() in changes else f"`{c.name}`" for c in schema)
    hit = spark.sql(f"SELECT {new} FROM {table.name} AS {table.alias} WHERE {where}")
    rest = spark.sql(f"SELECT * FROM {table.name} AS {table.alias} WHERE NOT ({where}) OR ({where}) IS NULL")
    _replace(spark, table, hit.unionByName(rest))


def merged(spark: SparkSession, table: Table, source: str, alias: str, on: str, clauses: list[tuple[bool, str, str, dict[str, str]]]) -> None:
    """One outer join tells matched, unmatched and new rows; the first clause whose condition holds applies to a row."""
    schema = spark.table(table.name).schema
    names = [c.name.upper() for c in schema]
    own, other = f"(SELECT *, monotonically_increasing_id() AS __row FROM {table.name})", f"(SELECT *, true AS __given FROM {source})"
    matched, new = [c for c in clauses if c[0]], [c for c in clauses if not c[0]]
    # Which clause applies, from 1; 0: none. A row of the target alone stays, one of the source alone is dropped.
    which = lambda some: "CASE " + " ".join(f"WHEN {c[1]} THEN {i}" for i, c in enumerate(some, 1)) + " ELSE 0 END" if some else "0"
    picked = f"CASE WHEN {alias}.__given IS NULL THEN 0 WHEN {table.alias}.__row IS NULL THEN -({which(new)}) ELSE {which(matched)} END"

    def value(column) -> str:
        name = column.name.upper()
        cases = [f"WHEN __case = {i} THEN CAST(({c[3][name]}) AS {column.dataType.simpleString()})" for i, c in enumerate(matched, 1) if name in c[3]]
        for i, c in enumerate(new, 1):
            key = name if name in c[3] else str(names.index(name))
            cases.append(f"WHEN __case = -{i} THEN " + (f"CAST(({c[3][key]}) AS {column.dataType.simpleString()})" if key in c[3] else "NULL"))
        return f"CASE {' '.join(cases)} ELSE {table.alias}.`{column.name}` END AS `{column.name}`" if cases else f"{table.alias}.`{column.name}`"

    gone = [str(i) for i, c in enumerate(matched, 1) if c[2] == "DELETE"]
    joined = f"{own} AS {table.alias} FULL OUTER JOIN {other} AS {alias} ON {on}"
    select = ", ".join(value(c).replace("__case", f"({picked})") for c in schema)
    rows = spark.sql(f"SELECT {select}, {table.alias}.__row AS __row, ({picked}) AS __case FROM {joined}")
    rows = rows.where((F.col("__row").isNotNull() | (F.col("__case") < 0)) & ~F.col("__case").isin(*map(int, gone or ["9999"])))
    rows = settled(rows)
    twice = rows.where("__case > 0").groupBy("__row").count().where("count > 1")
    if not twice.isEmpty():
        raise Ambiguous(f"rows of {table.name} match several rows of the source")
    # A row that matched several times but changes nothing is still one row.
    same = rows.where("__row IS NOT NULL").dropDuplicates(["__row"]).unionByName(rows.where("__row IS NULL"))
    _replace(spark, table, same.select(*(f"`{c.name}`" for c in schema)))


def copied(spark: SparkSession, name: str, path: str, options: dict[str, str]) -> None:
    """Files appended to a table, by place (CSV) or by name."""
    kind = options.get("TYPE", "CSV").upper()
    schema = spark.table(name).schema
    if kind == "CSV":
        reader = spark.read.option("header", int(options.get("SKIP_HEADER", 0) or 0) > 0).option("sep", options.get("FIELD_DELIMITER", ",")).option("escape", '"')
        found = reader.csv(path)
        rows = found.toDF(*(f"_{i}" for i in range(len(found.columns)))).select(*(F.col(f"_{i}").cast(c.dataType).alias(c.name) if i < len(found.columns) else F.lit(None).cast(c.dataType).alias(c.name) for i, c in enumerate(schema)))
    elif kind in ("JSON", "PARQUET"):
        found = spark.read.schema(schema).json(path) if kind == "JSON" else spark.read.parquet(path)
        have = {c.upper(): c for c in found.columns}
        rows = found.select(*((F.col(f"`{have[c.name.upper()]}`") if c.name.upper() in have else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema))
    else:
        raise ValueError(f"no reader for files of type {kind}")
    rows.write.insertInto(name)

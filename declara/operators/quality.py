"""Six checks of tables, each a query for its violations: (ordinal, message).

``table`` has string columns and ``ordinal`` (the first data row is 2). Values
are compared as they are; only ``not_null`` looks for blanks and NULL in any case.
"""

from __future__ import annotations

import ast
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import settled

KEPT = 20
BUILTINS = {f.__name__: f for f in (int, float, str, bool, len, abs, min, max, round, sum, sorted)}
RESULT = "test_case string, passed boolean, message string, n_failing long, failing_rows array<string>"


@dataclass
class Case:
    name: str
    source: str
    test: str
    column: str | None = None
    values: list[str] = field(default_factory=list)
    min: int | None = None
    max: int | None = None
    to: str | None = None
    to_column: str | None = None
    expression: str | None = None


def unique(table: DataFrame, column: str) -> DataFrame:
    """Each repeat with the first row of its value; nulls and empty strings are values."""
    first = table.groupBy(F.col(column).alias("__value")).agg(F.min("ordinal").alias("first_row"), F.count("*").alias("n")).where("n > 1")
    rows = table.join(first, F.col(column).eqNullSafe(F.col("__value"))).where("ordinal > first_row")
    return rows.select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": duplicate '"), F.coalesce(column, F.lit("")), F.lit("' (first seen row "), F.col("first_row"), F.lit(")")).alias("message"))


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^(?U)\s*$") | (F.upper(value) == "NULL")


def not_null(table: DataFrame, column: str) -> DataFrame:
    return table.where(is_blank(F.col(column))).select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": null or empty")).alias("message"))


def accepted_values(table: DataFrame, column: str, values: list[str]) -> DataFrame:
    bad = F.coalesce(~F.col(column).isin(values), F.lit(True))
    return table.where(bad).select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": unexpected '"), F.coalesce(column, F.lit("")), F.lit("'")).alias("message"))


def row_count(table: DataFrame, low: int | None, high: int | None) -> DataFrame:
    n = table.agg(F.count("*").alias("n"))
    within = F.col("n").between(low or 0, high if high is not None else 2**62)
    shown = f"expected {low or 0} to {'any' if high is None else high}"
    return n.where(~within).select(F.lit(0).cast("long").alias("ordinal"), F.concat(F.col("n"), F.lit(f" rows, {shown}")).alias("message"))


def relationship(table: DataFrame, column: str, target: DataFrame, to_column: str) -> DataFrame:
    """Values, but for empty ones, that the target lacks."""
    keys = target.select(F.col(to_column).alias("__key")).distinct()
    rows = table.where(F.coalesce(F.col(column) != "", F.lit(False))).join(keys, F.col(column) == F.col("__key"), "left_anti")
    return rows.select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": orphan '"), F.col(column), F.lit("'")).alias("message"))


class Rejected(ValueError):
    pass


ALLOWED = (
    ast.Expression, ast.BoolOp, ast.BinOp, ast.UnaryOp, ast.Compare, ast.Call, ast.IfExp, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple, ast.Set, ast.Subscript,
    ast.Slice, ast.boolop, ast.operator, ast.unaryop, ast.cmpop,
)


def compiled(expression: str):
    """Code of an expression of names, constants, operators and calls of BUILTINS; nothing has attributes."""
    tree = ast.parse(expression.strip(), mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED) or (isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in BUILTINS)):
            raise Rejected(f"{type(node).__name__} is not allowed in an expression")
    return compile(tree, "<expression>", "eval")


def expression(table: DataFrame, code: str) -> DataFrame:
    """Rows for which it is false, or fails. Columns are strings."""
    compiled(code)
    names = [c for c in table.columns if c != "ordinal"]

    @F.pandas_udf("string")
    def failing(row: pd.DataFrame) -> pd.Series:
        program = compiled(code)

        def one(values: tuple) -> str | None:
            try:
                return None if eval(program, {"__builtins__": {}, **BUILTINS}, dict(zip(names, values))) else "is false"
            except Exception as e:  # the row fails, whatever its reason
                return f"{type(e).__name__}: {e}"

        return pd.Series([one(v) for v in row[names].itertuples(index=False, name=None)], dtype=object)

    told = table.select("ordinal", failing(F.struct(*names)).alias("why")).where("why is not null")
    return told.select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": "), F.col("why")).alias("message"))


def sql_expression(table: DataFrame, predicate: str) -> DataFrame:
    """The same for a SQL predicate, which the optimizer sees."""
    return table.where(~F.coalesce(F.expr(predicate), F.lit(False))).select("ordinal", F.concat(F.lit("row "), F.col("ordinal"), F.lit(": is false")).alias("message"))


def violations(case: Case, table: DataFrame, target: DataFrame | None = None) -> DataFrame:
    if case.test in ("unique", "not_null", "accepted_values", "relationship") and case.column not in table.columns:
        raise ValueError(f"no column {case.column!r}; there are {', '.join(c for c in table.columns if c != 'ordinal')}")
    match case.test:
        case "unique":
            return unique(table, case.column)
        case "not_null":
            return not_null(table, case.column)
        case "accepted_values":
            if not case.values:
                raise ValueError("no values are given")
            return accepted_values(table, case.column, case.values)
        case "row_count":
            return row_count(table, case.min, case.max)
        case "relationship":
            if target is None or not case.to_column:
                raise ValueError("a relationship needs to and to_column")
            return relationship(table, case.column, target, case.to_column)
        case "expression":
            return expression(table, case.expression or "")
        case "sql_expression":
            return sql_expression(table, case.expression or "")
    raise ValueError(f"no test {case.test!r}; there are unique, not_null, accepted_values, row_count, relationship, expression, sql_expression")


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count of a partition's rows, and its first KEPT."""
    n, first = 0, []
    for batch in batches:
        n += batch.num_rows
        first = heapq.nsmallest(KEPT, [*first, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
    yield pa.RecordBatch.from_arrays([pa.array([n, *[0] * len(first)], pa.int64()), pa.array([None, *(o for o, _ in first)], pa.int64()), pa.array([None, *(m for _, m in first)], pa.string())], names=["n", "ordinal", "message"])


def summary(name: str, found: DataFrame) -> DataFrame:
    """One result row, from one pass: the count is of all violations, the first KEPT are shown."""
    heads = found.select(F.col("ordinal").cast("long"), "message").mapInArrow(_heads, "n long, ordinal long, message string")
    shown = F.slice(F.array_sort(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "message")))), 1, KEPT)
    return heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), shown.alias("shown")).select(
        F.lit(name).alias("test_case"), (F.col("n") == 0).alias("passed"), F.when(F.col("n") == 0, "ok").otherwise(F.concat(F.col("n"), F.lit(" failing"))).alias("message"),
        F.col("n").alias("n_failing"), F.col("shown.message").alias("failing_rows"),
    )


def run(spark: SparkSession, cases: list[Case], tables) -> DataFrame:
    """Results of all cases; ``tables(name)`` gives a table. Each case runs by itself, and one that cannot has failed."""
    out = spark.createDataFrame([], RESULT)
    for case in cases:
        try:
            table = tables(case.source)
            result = settled(summary(case.name, violations(case, table, tables(case.to) if case.to else None)))
        except Exception as e:
            reason = str(e).strip().splitlines() or [type(e).__name__]
            result = spark.createDataFrame([(case.name, False, f"Error running test: {reason[0]}", 0, [])], RESULT)
        out = out.unionByName(result)
    return out

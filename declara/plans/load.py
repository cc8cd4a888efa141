"""Loading CSV files as typed tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import spark_type
from ..operators.state import Store, latest_success
from ..operators.tables import place
from ..sources.project import _bare, column_types, listed, read_csv_fast, read_csv_strict, sidecars, stem_of

BATCH = 1000
#: Files over this many bytes have no binary row; their checksum is made from a stream.
LARGE = 1 << 30


@dataclass
class Loaded:
    name: str
    path: str
    checksum: str
    rows: int
    status: str
    error: str = ""
    columns: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)


def as_value(c: Column) -> Column:
    """Empty, or NULL in any case: null."""
    return F.when((c != "") & (F.upper(c) != "NULL"), c)


def literal(c: Column) -> Column:
    """The SQL literal of a value."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(as_value(c), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def typed(table: DataFrame, types: dict[str, str]) -> DataFrame:
    """Upper-cased columns with their declared types, strings where none is declared."""
    return table.select(*(as_value(F.col(f"`{c}`")).cast(spark_type(types.get(c.strip().upper(), "VARCHAR"))).alias(c.strip().upper()) for c in table.columns if c != "ordinal"))


def batch_id(ordinal: Column, size: int = BATCH) -> Column:
    return F.floor((ordinal - 2) / size).cast("long")


def file_checksum(spark: SparkSession, path: str, size: int) -> str:
    """md5 of the bytes."""
    if size < LARGE:
        return spark.read.format("binaryFile").load(path).select(F.md5("content")).first()[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()


def scan(spark: SparkSession, folder: str, schema: str) -> list[Loaded]:
    """The CSV files below ``folder``, by path, with what is known of them before any row is read; an empty file has failed."""
    told, out = {_bare(k): v for k, v in sidecars(spark, folder).items()}, []
    for path, size in listed(spark, folder, "*.csv"):
        one = Loaded(f"{schema}.{stem_of(path)}".upper(), path, "", 0, "FOUND")
        try:
            one.checksum = file_checksum(spark, path, size)
            one.columns = [c.strip().upper() for c in read_csv_fast(spark, path).columns]
            one.types = column_types(told.get(_bare(path.rsplit(".", 1)[0]), {}))
            if not one.columns:
                raise ValueError("the file is empty")
        except Exception as e:
            one.status, one.error = "FAILED", str(e)
        out.append(one)
    return out


def read_rows(spark: SparkSession, path: str, *, keep_blank: bool = False) -> DataFrame:
    """A file's rows as strings. keep_blank: a blank line is a row of nulls (the strict reader tells them)."""
    if not keep_blank:
        return read_csv_fast(spark, path)
    header = read_csv_fast(spark, path).columns
    rows = read_csv_strict(spark, path, keep_blank=True)
    return rows.select(*(F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(header)))


def load(spark: SparkSession, folder: str, schema: str = "public", store: Store | None = None, *, mode: str = "overwrite", force: bool = False, dry_run: bool = False, keep_blank: bool = False) -> list[Loaded]:
    """Every CSV file below ``folder`` as a table named after it; unchanged ones are skipped, failures do not stop the rest.

    dry_run: says what would be loaded, and how many rows, and writes nothing.
    """
    found = scan(spark, folder, schema)
    if dry_run:
        for one in found:
            one.rows = read_rows(spark, one.path, keep_blank=keep_blank).count() if one.status == "FOUND" else 0
        return found
    place(spark, schema, "")
    last = {}
    if store is not None:
        rows = latest_success(store.read("deploy_history").where("object_type = 'DATA'")).select("object_fqn", "checksum")
        last = {r["object_fqn"]: r["checksum"] for r in rows.toLocalIterator()}  # a row for each file of the project
    for one in found:
        if one.status == "FOUND" and not force and last.get(one.name) == one.checksum:
            one.status = "SKIPPED"
            continue
        table = f"{schema}.{stem_of(one.path)}"
        if one.status == "FOUND":
            try:
                before = spark.table(table).count() if mode == "append" and spark.catalog.tableExists(table) else 0
                rows = typed(read_rows(spark, one.path, keep_blank=keep_blank), one.types)
                rows.write.mode(mode).option("path", place(spark, schema, stem_of(one.path))).saveAsTable(table)
                one.rows, one.status = spark.table(table).count() - before, "SUCCESS"  # from the written files' footers
            except Exception as e:
                one.status, one.error = "FAILED", str(e)
        if store is not None:
            store.record([(one.name, "DATA", one.path, one.checksum, one.status, one.error or None, None)])
    return found

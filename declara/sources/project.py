"""Reading a project's files."""

from __future__ import annotations

import csv
import fnmatch
import io
import logging
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def listed(spark: SparkSession, folder: str, glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, empty ones too, in order. Nothing where there is no folder."""
    if not there(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():  # a project's files
        one = found.next()
        if fnmatch.fnmatch(one.getPath().getName(), glob):
            out.append((one.getPath().toString(), one.getLen()))
    return sorted(out)


def read_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(file_path, text) of all files below a folder, in the order of paths; a file that cannot be read is logged and left out."""
    if not there(spark, folder):
        log.error("no folder %s", folder)
        return spark.createDataFrame([], "file_path string, text string")
    files = spark.read.option("ignoreCorruptFiles", True).text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text")).orderBy("file_path")


def read_corpus(spark: SparkSession, folder: str, glob: str = "*.sql") -> DataFrame:
    """(file_path, raw_sql, checksum) of all SQL files below a folder, a row each."""
    return read_texts(spark, folder, glob).select("file_path", F.col("text").alias("raw_sql"), F.md5(F.col("text").cast("binary")).alias("checksum"))


def read_csv_fast(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """A CSV file as a table of strings, by Spark's own reader: no ordinals, and an empty field is a null like a missing one.

    Records of other widths are cut or padded. With ``multiline=False`` no quoted
    field may hold a line end, and a large file is split between tasks.
    """
    return spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_csv_strict(spark: SparkSession, path: str, *, keep_blank: bool = False, pad: str | None = "") -> DataFrame:
    """(file_path, checksum, ordinal, header, fields): every record of CSV files, with its place.

    The first record is the header; records of other widths are cut or padded
    (with ``pad``; None tells a missing field from an empty one); the first data
    record is number 2. A quoted field may hold line ends. Each file is parsed
    by one task, as records have no marks to split at; files are the unit of
    parallelism, and ``spark.read.csv`` serves where places do not matter.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, checksum, content in zip(batch["path"], batch["checksum"], batch["content"]):
                reader = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                header = next(reader, None)
                rows, at = [], 1
                for fields in reader:
                    if not fields and not keep_blank:
                        continue
                    at += 1
                    if len(fields) > len(header):
                        log.warning("%s: record %d has %d fields, the header %d; the rest is cut", path, at, len(fields), len(header))
                    rows.append((path, checksum, at, header, (fields + [pad] * len(header))[: len(header)]))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if header is not None:
                    yield pd.DataFrame(rows, columns=names)

    names = ["file_path", "checksum", "ordinal", "header", "fields"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    files = files.select("path", F.md5("content").alias("checksum"), "content")
    return files.mapInPandas(run, "file_path string, checksum string, ordinal long, header array<string>, fields array<string>")


def csv_table(spark: SparkSession, path: str, *, pad: str | None = None) -> DataFrame:
    """One CSV file as a table of strings, with ``ordinal``."""
    if not there(spark, path):
        raise FileNotFoundError(path)
    header = read_csv_fast(spark, path).columns
    if not header:
        raise ValueError(f"{path} is empty")
    rows = read_csv_strict(spark, path, pad=pad)
    return rows.select("ordinal", *(F.get("fields", F.lit(i)).alias(name) for i, name in enumerate(header)))


def sidecars(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The YAML files below a folder by path without suffix; <stem>.yml goes before <stem>.yaml."""
    import yaml

    out: dict[str, dict] = {}
    for glob in ("*.yaml", "*.yml"):
        for r in read_texts(spark, folder, glob).collect() if there(spark, folder) else []:  # a project's sidecars
            told = yaml.safe_load(r["text"])
            out[r["file_path"].rsplit(".", 1)[0]] = told if isinstance(told, dict) else {}
    return out


def stem_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def column_types(told: dict) -> dict[str, str]:
    """Declared types of a sidecar, by upper-cased column."""
    return {str(k).upper(): str(v) for k, v in (told.get("columns") or {}).items()}


def declared_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, sources, targets, description) from sidecars of SQL files that name any."""
    told, rows = sidecars(spark, folder), []
    for path, _ in listed(spark, folder, "*.sql") if told else []:
        own = next((v for k, v in told.items() if _bare(k) == _bare(path.rsplit(".", 1)[0])), {})
        lists = [[str(x).strip().upper() for x in own.get(k) or []] for k in ("sources", "targets")]
        if any(lists):
            rows.append((path, *lists, str(own.get("description") or "")))
    return spark.createDataFrame(rows, "file_path string, sources array<string>, targets array<string>, description string")


def _bare(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/")


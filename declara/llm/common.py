"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import string
import tempfile
import uuid
import weakref
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BITS = 28
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
_written: list[tuple[weakref.ref, str]] = []
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if (app := spark.sparkContext.applicationId) not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="declara-")
    return _own[app]


#: Settings of batches: what they are when nobody has set them, and what suits rows that are texts.
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": (("64m", "67108864", "67108864b"), "4m"),
    "spark.sql.parquet.columnarReaderBatchSize": (("4096",), "512"),
}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches hold a few MB of texts, unless it says otherwise: an executor and its workers hold several at once."""
    conf = df.sparkSession.conf
    for key, (unset, suits) in BATCHES.items():
        if conf.get(key, unset[0]) in unset:
            conf.set(key, suits)
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read of its files, not the
    work above, and several consumers do not recompute it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_keys(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", nulls: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a long ``key`` that no two rows share, and (key, its id) where the two differ (None: nowhere).

    A row's key is its id. Rows without an id (with ``nulls``; without, theirs
    stays null) and those whose id others have too are written once with keys
    after all ids, in the order of id and text. Where ids leave no room above
    them, those keys are 64-bit hashes.
    """
    own = F.col(id_col).cast("long")
    ids = docs.select(own.alias("own_id"))
    shared = ids.groupBy("own_id").count().where("own_id is null or count > 1" if nulls else "own_id is not null and count > 1").select("own_id")
    shared = stored(shared, "shared")
    if shared.isEmpty():
        return docs.withColumn(key, own), None
    top = ids.agg(F.max("own_id")).first()[0]
    top = -1 if top is None else max(top, -1)
    at = F.monotonically_increasing_id()
    fresh = at + F.lit(top + 1) if top < 1 << 62 else F.xxhash64(F.lit("own key"), at)
    same = own.eqNullSafe(F.col("own_id"))
    odd = docs.join(shared, same, "left_semi").orderBy(own, F.xxhash64(text_col), F.col(text_col))
    odd = stored(odd.withColumn(key, fresh), "odd")
    return docs.join(shared, same, "left_anti").withColumn(key, own).unionByName(odd), odd.select(key, own.alias("own_id"))


def release() -> None:
    """Remove everything ``scratch`` has handed out."""
    while _written:
        ref, path = _written.pop()
        try:
            spark = ref()
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            continue


atexit.register(release)


class Marks(NamedTuple):
    """A bitmap of hashes, in rows of 4 KiB, and the binary logarithm of its size."""

    rows: DataFrame
    bits: int


def marks_of(ids: DataFrame, key: str) -> Marks:
    """A bitmap for ``perhaps_in`` of the ``key`` of a stored table: some 16 bits an id, but never over 2 ** MOST_BITS (32 MiB).

    Ids are gathered by bucket before bits are set, so that tasks send ids, not bitmaps.
    """
    bits = min(MOST_BITS, max(15, (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    placed = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).distinct()
    return Marks(stored(placed.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "marks"), bits)


def perhaps_in(rows: DataFrame, key: str, marks: Marks) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be among the ids of ``marks`` (all that are, and a few more), and the rest.

    Rows that have no partner thus skip a join's shuffle. The bitmap is broadcast: its size has a bound. Past some
    hundred million ids it fills up, and all rows go to the join.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << marks.bits))
    bits = F.broadcast(marks.rows.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.expr("coalesce(shiftright(_byte, cast(_bit % 8 as int)) & 1, 0) = 1")
    found = rows.join(bits, F.bitmap_bucket_number(place) == F.col("_bucket"), "left").withColumns({"_byte": byte, "_bit": at}).withColumn("_hit", hit)
    return found.where("_hit").select(*rows.columns), found.where("not _hit").select(*rows.columns)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Carried:
    """A table as (id, text, rest): its other columns in one struct, so that no name of theirs clashes with an inner one.

    Columns that have the name of one the operator adds give way to it.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, adds: tuple[str, ...] = ()):
        taken = {a.lower() for a in adds} - {id_col.lower(), text_col.lower()}
        self.names, self.id_col, self.text_col = [c for c in docs.columns if c.lower() not in taken], id_col, text_col
        others = [quoted(c).alias(f"c{i}") for i, c in enumerate(self.names) if c not in (id_col, text_col)] or [F.lit(True).alias("none")]
        self.rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), F.struct(*others).alias("rest"))

    def out(self, rows: DataFrame, *more: Column) -> DataFrame:
        """The columns of the table in their order, from rows that have id, text and rest, then ``more``."""
        own = {self.id_col: F.col("id"), self.text_col: F.col("text")}
        return rows.select(*(own.get(c, F.col("rest")[f"c{self._at(c)}"]).alias(c) for c in self.names), *more)

    def _at(self, name: str) -> int:
        return self.names.index(name)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` alone would touch other letters, so it serves pure ASCII texts only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fits(df: DataFrame, size: Column, most: int) -> bool:
    """Whether the rows of ``df``, of ``size`` bytes each, stay under ``most``: for checks before a broadcast."""
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]

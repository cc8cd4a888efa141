"""The training-data pipeline: five stages over ``documents``, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Stages that compare documents give each row a
key of its own, so that rows without a doc_id, or with a common one, are judged
like all others.

Defined results, of all stages: an empty table stays empty; columns that the
stages do not know are carried along to the last one; texts are read whole. What
becomes of null and empty texts and of ties is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declara.llm.common import Carried, marks_of, own_keys, perhaps_in, stored, table
from declara.llm.decontaminate import decontaminate
from declara.llm.language import UNDETERMINED, identify
from declara.llm.lines import dedup_lines
from declara.llm.near_dup import near_duplicates
from declara.llm.pack import pack
from declara.llm.q_language import fold

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that can be told go: null and empty texts, those without letters, and those whose best language scores under LEAST_SCORE."""
    kept = Carried(docs, "doc_id", "text")
    found = identify(kept.rows, docs.where(fold() != 2).select("doc_id", "text", "lang"), carried=kept.rows.columns)
    return kept.out(found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go (the earliest stays), and documents that consisted of them. Null and empty texts stay as they are."""
    rest = dedup_lines(docs)
    rest = rest.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rest.select(*docs.columns)


def _without(docs: DataFrame, gone) -> DataFrame:
    """``docs`` without the rows whose keys ``gone``(keyed table of (key, text, carried columns)) gives as column ``key``."""
    kept = Carried(docs, "doc_id", "text")
    keyed, _ = own_keys(kept.rows, "key", "id")
    keys = stored(gone(keyed), "gone")
    some, others = perhaps_in(keyed, "key", marks_of(keys, "key"))
    return kept.out(some.join(keys, "key", "left_anti").unionByName(others))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, 0.8): the one with the smallest doc_id. Texts without words are like nothing."""
    return _without(docs, lambda keyed: near_duplicates(keyed, id_col="key").where(~F.col("kept")).select(F.col("doc_id").alias("key")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Texts without words have none."""
    return _without(docs, lambda keyed: decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="key").where("contaminated").select("key"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences. A null or empty text is its end id alone; rows with one doc_id are packed each."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Learned languages, sketches and token ids are not SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Query op2 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import canonical, format_chats, masked_text, parse_chat
from .common import table

ADDED = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{ADDED}'), (-7L, 1L, 'assistant', '{ADDED}') AS t(conv_id, turn, role, text)")
    chats = format_chats(canonical(rows.union(added)))
    back = parse_chat(F.col("formatted"))
    read = chats.select("conv_id", "formatted", back.alias("back"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ADDED}', NULL), (-7, 1, 'assistant', '{ADDED}', NULL)
), shaped AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g')) AS n_text,
         length(replace(regexp_replace(replace(role, '\', '\\'), '(<|\[)(/?(?:s>|INST\]))', '\1\\\2', 'g'), chr(10), '\n')) AS n_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + n_role + n_text)::BIGINT AS formatted_chars
FROM shaped GROUP BY conv_id, own
"""

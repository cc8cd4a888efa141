"""Query op6 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import round_trip


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: A SHA-1 is 40 hexadecimal digits: each five of them are 20 bits, four digits of base 32.
_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {i}, 5))::BIGINT >> {shift}) & 31), 1)" for i in range(1, 41, 5) for shift in (15, 10, 5, 0)
)
OP6_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""

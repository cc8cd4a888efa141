"""Query op9 and its SQL, which searches whole texts for each kind and computes places, check sums and headers anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import find_secrets


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def _either(word: str) -> str:
    """A word whose ASCII letters may be in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
#: Kind: what to find (leftmost, not overlapping), and which matches `m` stay.
_SEARCHES = {
    "assign": (rf"(?:{_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+", rf"length(regexp_extract(m, '(?:{_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"),
    "hex": ("[0-9a-f]+", "length(m) >= 24"),
    "issued": ("(?:gh[pousr]|npm)_[0-9A-Za-z]{36}(?:[^0-9A-Za-z]|$)", "crc = told"),
    "web": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "coalesce(json_type(head) = 'OBJECT', false)"),
    "key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\\x09-\x0D\x20]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", "true"),
}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(5, 35), lambda i: ascii(m[i])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda t, n: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295)"""
_TOLD = f"list_reduce([0::BIGINT] || list_transform(range(35, 41), lambda i: (strpos('{_DIGITS}', m[i]) - 1)::BIGINT), lambda v, d: v * 62 + d)"
_HEAD = "TRY(decode(from_base64(rpad(translate(split_part(m, '.', 1), '-_', '+/'), ((length(split_part(m, '.', 1)) + 3) // 4 * 4)::INTEGER, '='))))"
_ALL = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS rank, '{kind}' AS kind, s, m FROM (
  SELECT doc_id, {"left(m, 40)" if kind == "issued" else "m"} AS m, sum(length(before) + coalesce(length(prior), 0)) OVER (PARTITION BY doc_id ORDER BY k) AS s,
         {_CRC if kind == "issued" else "0"} AS crc, {_TOLD if kind == "issued" else "0"} AS told, {_HEAD if kind == "web" else "NULL"} AS head
  FROM (SELECT doc_id, k, ms[k] AS m, parts[k] AS before, ms[k - 1] AS prior
        FROM (SELECT doc_id, ms, parts, unnest(range(1, len(ms) + 1)) AS k
              FROM (SELECT doc_id, regexp_extract_all(text, '{search}') AS ms, string_split_regex(text, '{search}') AS parts FROM d)))
  ) WHERE {keep}"""
    for i, (kind, (search, keep)) in enumerate(_SEARCHES.items())
)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({_ALL}),
shown AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + length(m)) AS span FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM d LEFT JOIN shown ON d.doc_id = shown.doc_id GROUP BY d.doc_id
"""

"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased, white-space-separated words, weighted by how often
they occur. For each of ``samples`` coordinates and each term with weight w:

    t = floor(ln w / r + b),  ln a = ln c - r * (t - b) - r

with r, c ~ Gamma(2, 1) and b ~ U(0, 1) drawn from the term and the coordinate;
the coordinate keeps the (term, t) with the smallest a. Two texts agree at a
coordinate with the probability of their generalised Jaccard similarity (sum of
the smaller weights over sum of the larger ones), plus 2 ** -16 of the rest:
a fingerprint names the (term, t) in 16 bits.

A draw is a mix of the word's 64-bit hash with the coordinate's number, so that
different words stay different terms, however many there are. It is taken apart
another way, which leaves one number to draw for a word that occurs once: with
e, d, q ~ Exp(1), let c = e + d, s = ln(c / e), r = s + q and b = q / r. These
have the distributions above, and

    t = floor((ln w + q) / r),  ln a = ln e - r * t

so a is e where w is 1, and e grows with the mix it is made from.

``with_next`` brings each document together with its successor in the order of
doc_id (then text). Documents are dealt into ranges of ids whose bounds come
from quantiles; the first document of every range is also sent to the range
before it (that of the first range to the last one), so each range is read once,
sorted, as a stream, and no text takes part in a global sort or a join.

Defined results: null text is empty; an empty text, or one of white space, has
the empty fingerprint, which is like another empty one (1) and unlike all
others (0); a null id comes before all others; rows that share an id follow each
other by text, so repeated rows are neighbours (one task reads all rows of an id);
a single document is its own successor; an empty table has no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches
from .kept import Cache, held

#: Terms whose draws are made at a time: they stay in the processor's cache, and a long text needs no more memory.
BLOCK = 1024
_coordinates: dict[int, np.ndarray] = {}


def coordinates(samples: int) -> np.ndarray:
    """Three numbers to mix for each coordinate: for e, d and q."""
    if samples not in _coordinates:
        _coordinates[samples] = np.random.Generator(np.random.PCG64(20_010)).integers(0, 1 << 64, (samples, 3), np.uint64).T.copy()
    return _coordinates[samples]


def drawn(hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """64 even bits for each hash (down) and coordinate (across)."""
    x = hashes[:, None] ^ numbers
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
    return x


def exponential(bits: np.ndarray) -> np.ndarray:
    """Exp(1), growing with the bits."""
    return -np.log1p(((bits >> np.uint64(12)).astype(np.float64) + 0.5) * -(2.0**-52))


def weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the text's terms, and their counts."""
    known, counts = held("fingerprint", lambda: Cache(200_000, _hashed)), Counter(text.lower().split())
    hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts))
    return hashes, np.fromiter(counts.values(), np.int64, len(counts))


def _hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def signature(text: str, samples: int) -> np.ndarray | None:
    """A 16-bit number for each coordinate."""
    hashes, counts = weights(text)
    if not len(hashes):
        return None
    for_e, for_d, for_q = coordinates(samples)
    least, named, t = np.full(samples, np.inf), np.zeros(samples, np.uint64), np.zeros(samples, np.uint64)
    across = np.arange(samples)
    single, many = hashes[counts == 1], np.flatnonzero(counts > 1)
    for i in range(0, len(single), BLOCK):
        some = single[i : i + BLOCK]
        bits = drawn(some, for_e)
        best = bits.argmin(axis=0)
        a = exponential(bits[best, across])
        less = a < least
        least[less], named[less] = a[less], some[best[less]]
    for i in range(0, len(many), BLOCK):
        some, log_w = hashes[many[i : i + BLOCK]], np.log(counts[many[i : i + BLOCK]])[:, None]
        e, d, q = (exponential(drawn(some, x)) for x in (for_e, for_d, for_q))
        r = np.log1p(d / e) + q
        steps = np.floor((log_w + q) / r)
        e *= np.exp(-r * steps)
        best = e.argmin(axis=0)
        a = e[best, across]
        less = a < least
        least[less], named[less], t[less] = a[less], some[best[less]], steps[best[less], across[less]].astype(np.uint64)
    named = (named + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + t * np.uint64(0xD1B54A32D192ED03)
    named = (named ^ named >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (named >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much from the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def ranges(docs: DataFrame, per_range: int) -> list[int]:
    """Upper bounds (exclusive) of the id ranges but the last."""
    n = docs.count()
    parts = max(1, min(20_000, -(-n // per_range)))
    found = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    return sorted({int(x) for x in found})


def _passed(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``, by bisection: the work for a row grows with their logarithm."""
    at = F.from_json(F.lit(str(bounds)), "array<long>")  # one literal
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(powers, F.lit(0), lambda passed, power: F.when(F.get(at, passed + power - 1) <= value, passed + power).otherwise(passed))


def with_next(docs: DataFrame, per_range: int = 1000) -> tuple[DataFrame, int]:
    """Rows (part, follows, doc_id, text): each range's documents, and (follows) the one after its last."""
    bounds = ranges(docs, per_range)
    part = _passed(bounds, F.col("doc_id")) if bounds else F.lit(0)
    dealt = docs.withColumn("part", part)
    key = F.struct("doc_id", "text_key")
    dealt = dealt.withColumn("text_key", F.xxhash64("text"))
    firsts = sorted((r["part"], r["k"]) for r in dealt.groupBy("part").agg(F.min(key).alias("k")).collect())  # one row a range
    parts = [p for p, _ in firsts]
    before = {p: parts[i - 1] for i, p in enumerate(parts)}  # the first one's goes to the last
    spark = docs.sparkSession
    heads = spark.createDataFrame([(p, k["doc_id"], k["text_key"], before[p]) for p, k in firsts], "part int, head_id long, head_key long, to int")
    head = dealt.join(F.broadcast(heads), (dealt.part == heads.part) & dealt.doc_id.eqNullSafe(heads.head_id) & (dealt.text_key == heads.head_key))
    head = head.select(F.col("to").alias("part"), F.lit(True).alias("follows"), "doc_id", "text", "text_key")
    return dealt.select("part", F.lit(False).alias("follows"), "doc_id", "text", "text_key").union(head.dropDuplicates(["part"])), max(1, len(parts))


def fingerprints(docs: DataFrame, *, samples: int = 64, per_range: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and likenesses; see the query."""
    docs = small_batches(docs).select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    dealt, parts = with_next(docs, per_range)
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "follows", "doc_id", "text_key").select("part", "follows", "doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for part, follows, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py()
                signed = signature(text, samples)
                if held is not None and held[0] == part:
                    rows.append(_row(held, text, signed, samples))
                held = None if follows else (part, doc_id, text, signed)
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return dealt.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(held: tuple, following: str, next_signed: np.ndarray | None, samples: int) -> tuple:
    _, doc_id, text, signed = held
    changed = edited(text, following)
    changed_signed = signed if changed == text else signature(changed, samples)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, _hex(signed), _hex(changed_signed), likeness(signed, changed_signed), likeness(signed, next_signed)


def _hex(signed: np.ndarray | None) -> str:
    return "" if signed is None else signed.tobytes().hex()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

"""Benchmark decontamination by winnowed k-gram fingerprints.

A *window* is ``span`` consecutive words of a benchmark item (an item with
fewer words, but not none, is one window). A document word inside any
occurrence of a window is hit.

Both sides are fingerprinted alike: hash every ``gram``-word run, then keep the
smallest hash of each ``span - gram + 1`` consecutive runs. Two texts that share
``span`` words share the runs inside them, hence the smallest one, so every
shared window is found. Items shorter than ``span`` words have one run each (of
their own length, where winnowing keeps everything). Fingerprints that occur on
both sides are seeds; each seed is extended left and right to the windows that
contain it, and those are compared word by word with the benchmark's.

The benchmark side is broadcast only when its fingerprints and windows are under
``broadcast_bytes``, and so are the seeds; beyond that the joins shuffle.
Seeds find their documents again by key, so that no text is copied per
fingerprint.

Defined results: null text has no words; rows with one ``doc_id`` and one text
give one row, different texts of one ``doc_id`` or of none a row each; items
without words never match; ids of items may be of any type, repeated items count
once per ``item_id``, and one without an id marks words but is not listed; an
empty benchmark hits nothing; extra columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, let, lower_az, quoted, small_batches, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _joined(a: Column, step: int, with_next) -> Column:
    """``with_next`` of each entry and the one ``step`` further on, while there is one."""
    return let(a, lambda v: F.slice(F.zip_with(v, _shifted(v, step), lambda x, y: with_next(x, y)), 1, F.greatest(F.size(v) - step, F.lit(0))))


def _runs(hashes: Column, k: int) -> Column:
    """A hash of each k consecutive entries; of fewer than k entries, one that matches nothing."""
    return let(hashes, lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - k, F.lit(0))), lambda i: F.xxhash64(*(F.get(v, i + j) for j in range(k)))))


def _minima(hashes: Column, w: int) -> Column:
    """Distinct smallest hashes of each w consecutive ones."""
    low, width = hashes, 1
    while width < w:
        step = min(width, w - width)
        low, width = _joined(low, step, F.least), width + step
    return F.array_distinct(low)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    span: int = 10,
    gram: int = 4,
    broadcast_bytes: int = 64_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: words, hit words and the sorted ids of the items whose windows occur."""
    gram = min(gram, span)
    kind = benchmark.select("item_id").schema[0].dataType.simpleString()
    items = benchmark.select(F.col("item_id").alias("item"), words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = items.withColumn("len", F.least(F.size("iw"), F.lit(span)))
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # at most `span` values
    starts = F.explode(F.sequence(F.lit(1), F.size("iw") - F.col("len") + 1))
    windows = (
        items.select("item", "len", "iw", starts.alias("at"))
        .select("item", F.concat_ws(" ", F.slice("iw", F.col("at"), F.col("len"))).alias("window"), "len")
        .groupBy("window", "len")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    marks = [
        items.where(F.col("len") == n).select(F.explode(_marks(_word_hashes(F.col("iw")), n, span, gram)).alias("mark"), "len") for n in lengths
    ]
    # Texts that share an id, or have none, are documents of their own.
    docs = small_batches(docs).select(F.struct(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("text")).alias("doc"), quoted(text_col).alias("text"))
    if not lengths:
        return _result(docs.select("doc", F.size(words_of(F.col("text"))).cast("long").alias("n"), *_no_hits(kind)), id_col)
    known = marks[0]
    for more in marks[1:]:
        known = known.union(more)
    known = known.distinct()
    known, windows = stored(known, "marks"), stored(windows.select("window", F.col("len").alias("window_len"), "items"), "windows")
    listed = F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i.cast("string")) + 16)
    if fits(known, F.lit(24), broadcast_bytes) and fits(windows, F.octet_length("window") + listed + 48, broadcast_bytes):
        known, windows = F.broadcast(known), F.broadcast(windows)
    # Only keys and hashes pass the explode; a row without a mark keeps each document.
    hashed = docs.select("doc", words_of(F.col("text")).alias("words")).select("doc", F.size("words").cast("long").alias("n"), _word_hashes(F.col("words")).alias("hashes"))
    found = F.concat(F.array(F.lit(None).cast("long")), *(_marks(F.col("hashes"), n, span, gram) for n in lengths))
    seeds = hashed.select("doc", "n", F.explode(found).alias("at_mark")).join(known, F.col("at_mark") == F.col("mark"), "left")
    seeds = seeds.where(F.col("mark").isNotNull() | F.col("at_mark").isNull())
    seeds = seeds.groupBy("doc").agg(F.max("n").alias("n"), F.collect_set(F.when(F.col("mark").isNotNull(), F.struct("mark", "len"))).alias("seeds"))
    seeds = stored(seeds, "seeds")
    clear = seeds.where(F.size("seeds") == 0).select("doc", "n", *_no_hits(kind))
    seeded = seeds.where(F.size("seeds") > 0).select(F.col("doc").alias("key"), "n", "seeds")
    if fits(seeded, F.size("seeds") * 32 + 64, broadcast_bytes):
        seeded = F.broadcast(seeded)
    texts = docs.join(seeded, F.col("doc").eqNullSafe(F.col("key")))
    texts = texts.select("doc", "n", "seeds", words_of(F.col("text")).alias("words")).withColumn("hashes", _word_hashes(F.col("words")))
    texts = texts.select("doc", "n", "words", "hashes", F.explode(F.array_distinct(F.col("seeds.len"))).alias("len"), "seeds")
    cases = F.lit(None).cast("array<int>")
    for length in lengths:
        cases = F.when(F.col("len") == length, _extended(length, span, gram)).otherwise(cases)
    texts = texts.select("doc", "n", "len", cases.alias("starts"), "words")
    cut = F.transform("starts", lambda at: F.struct(at.alias("at"), F.concat_ws(" ", F.slice(F.col("words"), at, F.col("len"))).alias("hit")))
    hits = texts.select("doc", "n", "len", F.explode_outer(cut).alias("w")).select("doc", "n", "len", "w.at", "w.hit")
    hits = hits.join(windows, (F.col("hit") == F.col("window")) & (F.col("len") == F.col("window_len")), "left")
    spans = F.collect_set(F.when(F.col("items").isNotNull(), F.struct("at", "len")))
    hits = hits.groupBy("doc").agg(F.max("n").alias("n"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return _result(clear.union(hits), id_col)


def _no_hits(kind: str) -> list[Column]:
    return [F.array().cast("array<struct<at:int,len:int>>").alias("spans"), F.array().cast(f"array<{kind}>").alias("items")]


def _contains(values: Column, body) -> Column:
    """``body(has)`` where has(h) tells whether h is among ``values``, which are dealt into some sqrt(n) lists by remainder."""
    lists = F.ceil(F.sqrt(F.size(values))).cast("int")
    dealt = let(lists, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(values, lambda v: F.pmod(v, n) == i)))
    return let(dealt, lambda d: body(lambda h: F.array_contains(F.get(d, F.pmod(h, F.size(d)).cast("int")), h)))


def _marks(hashes: Column, n: int, span: int, gram: int) -> Column:
    k = gram if n == span else n
    return _minima(_runs(hashes, k), n - k + 1)


def _extended(n: int, span: int, gram: int) -> Column:
    """Starts (from 1) of the n-word windows that contain a seed, wherever its run occurs."""
    k = gram if n == span else n

    def around(has) -> Column:
        places = F.transform(_runs(F.col("hashes"), k), lambda h, i: F.when(has(h), i + 1))
        starts = F.transform(F.filter(places, lambda p: p.isNotNull()), lambda p: F.sequence(F.greatest(p - (n - k), F.lit(1)), p))
        return F.array_distinct(F.flatten(starts))

    starts = _contains(F.col("seeds.mark"), around)
    return let(F.size("words"), lambda total: F.filter(starts, lambda a: a + (n - 1) <= total))


def _result(hits: DataFrame, id_col: str) -> DataFrame:
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.at, s.at + s.len - 1))))
    hits = hits.select(F.col("doc.id").alias(id_col), F.col("n").alias("n_words"), F.size(inside).cast("long").alias("n_hit"), ids.alias("items"))
    return hits.withColumn("contaminated", F.col("n_hit") > 0)

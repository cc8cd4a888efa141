"""Line dedup: near-equal lines by a deletion-neighbourhood join.

A line's form is its words, A-Z lower-cased. Blank lines stay. A line of fewer
than ``min_words`` words is removed if an earlier one, by (doc_id, line number),
has the same form (with ``short_repeats=False``, for code or tables, all of them
stay). A longer line is removed if an earlier longer one has a form within
``max_edits`` (0 or 1) word insertions, deletions or replacements. Whether the
earlier line was itself removed makes no difference.

* Lines with equal forms are one class with one earliest place.
* Two forms are one edit apart only if they agree in a first or in a last half
  (of the shorter one's words), so classes that share no half with another are
  put aside, exactly, before any variant is made.
* What is left emits its variants: the form itself and the form without each
  one word, as hashed keys with the place of the word left out (-1: none).
  Forms that agree in key and place differ in the word at that place only, so
  the earliest of them settles the others. A form that is a key itself is one
  word short of all others of the key: it settles the later ones, and the
  earliest of them settles it. That is every pair that matters, at a number of
  comparisons that grows with the variants; each is verified on the words.
* A line or variant that a third of all rows have is a hot key: what it is
  joined with is a stored table, one row a key, so the join can be split.
* Of the texts only those with a line to vary, then those with a line to remove,
  are shuffled; a bitmap of bounded size tells them from the rest.

Defined results: null text stays null, empty text empty; line ends are ``\\n``;
equal lines of one text are repeats like any others; extra columns are carried
along, but for ``n_lines`` and ``n_removed``, which are replaced. Each row is
judged by itself: rows without a doc_id, and those that share one, come after
all others, by doc_id and text, so of equal rows one keeps its lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, let, marks_of, own_keys, perhaps_in, small_batches, stored
from .kept import held
from .near_dup import mixed

LINES = "doc_id long, line int, form long, half array<long>"


def words_of(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def form_of(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def halves(words: list[bytes]) -> list[int]:
    """Keys of the first and last halves that a form one edit away can share."""
    n, out = len(words), set()
    for k in {n // 2, (n - 1) // 2}:
        out.add(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:k]), 1)))
        out.add(_signed(xxhash.xxh3_64_intdigest(b" ".join(words[n - k :]), 2)))
    return sorted(out)


def variants(words: list[bytes]) -> np.ndarray:
    """Keys of the form and of the form without each one word, in the order of its place."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(h)
    with np.errstate(over="ignore"):
        place = mixed(np.arange(n + 1, dtype=np.uint64))
        here, before = mixed(h ^ place[:n]), mixed(h[1:] ^ place[: n - 1])  # a word where it is, and one place earlier
        head = np.concatenate([[np.uint64(0)], np.cumsum(here)])
        tail = np.concatenate([np.cumsum(before[::-1])[::-1], [np.uint64(0)]])
        keys = np.concatenate([[head[n] + place[n]], head[:n] + tail + place[n - 1]])
    return mixed(keys).view(np.int64)


def near(a: list[bytes], b: list[bytes], edits: int) -> bool:
    """Whether the word edit distance is at most 0 or 1."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if i == len(b):
        return True
    return edits == 1 and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lines(docs: DataFrame, min_words: int, short_repeats: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("lines", dict)
        for batch in batches:
            ids, at, forms, half = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    words = words_of(line)
                    if len(words) >= min_words or short_repeats and words:
                        ids.append(doc_id)
                        at.append(i)
                        forms.append(form_of(words))
                        half.append(halves(words) if len(words) >= min_words else [])  # none: no variants
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(forms, pa.int64()), pa.array(half, pa.list_(pa.int64()))], names=["doc_id", "line", "form", "half"])

    return docs.mapInArrow(run, LINES)


def _variants(lines: DataFrame) -> DataFrame:
    """(form, doc_id, line, words, keys) for the lines at (doc_id, wanted: their numbers) of ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for doc_id, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = text.split("\n")
                for i in (i for i in wanted if i < len(found)):
                    words = words_of(found[i])
                    for column, value in zip(out, (form_of(words), doc_id, i, b" ".join(words), variants(words))):
                        column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["form", "doc_id", "line", "words", "keys"])

    return lines.mapInArrow(run, "form long, doc_id long, line int, words binary, keys array<long>")


def _near(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) of forms that are one edit apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near(x.split(b" "), y.split(b" "), 1) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(words.select(F.col("form").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("form").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def repeated_lines(docs: DataFrame, *, max_edits: int = 1, min_words: int = 5, short_repeats: bool = True) -> DataFrame:
    """(doc_id, gone array<int>): numbers of the lines to remove. docs: (doc_id, text), ids distinct."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1: a line's variants leave out one word at most")
    lines = stored(_lines(small_batches(docs), min_words, short_repeats), "lines")
    first = F.min(F.struct("doc_id", "line")).alias("first")
    known = [F.first("half").alias("half")] if max_edits else []  # the same for all lines of a form
    classes = stored(lines.groupBy("form").agg(first, F.count("*").alias("n"), *known), "classes")
    marked = classes.select("form", "first", "n")
    if max_edits:
        spent = _settled_by_variants(docs, classes).withColumn("spent", F.lit(True))
        marked = marked.join(spent, "form", "left")
    else:
        marked = marked.withColumn("spent", F.lit(None).cast("boolean"))
    marked = stored(marked.where("n > 1 or spent"), "marked")
    gone = lines.join(marked, "form").where(F.coalesce("spent", F.lit(False)) | (F.struct("doc_id", "line") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def _settled_by_variants(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(form): those that are one edit from an earlier one."""
    half = classes.select("form", F.explode("half").alias("key"))
    shared = half.groupBy("key").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo < hi").select("key")
    some = half.join(stored(shared, "shared"), "key", "left_semi").select("form").distinct()
    wanted = classes.join(some, "form", "left_semi").groupBy("first.doc_id").agg(F.collect_list("first.line").alias("wanted"))
    wanted = stored(wanted, "wanted")
    texts, _ = perhaps_in(docs, "doc_id", marks_of(wanted, "doc_id"))
    varied = stored(_variants(texts.hint("merge").join(wanted, "doc_id").select("doc_id", "text", "wanted")), "variants")
    keyed = varied.select("form", "doc_id", "line", F.posexplode("keys").alias("place", "key")).withColumn("place", F.col("place") - 1)
    shared = keyed.groupBy("key").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo < hi").select("key")
    at = F.struct("doc_id", "line", "form").alias("at")
    keyed = stored(keyed.join(stored(shared, "shared"), "key", "left_semi").select("key", "place", at), "keyed")
    longer, whole = keyed.where("place >= 0"), keyed.where("place < 0").groupBy("key").agg(F.min("at").alias("whole"))
    leads = stored(longer.groupBy("key", "place").agg(F.min("at").alias("lead")), "leads")
    whole = stored(whole, "whole")
    replaced = longer.join(leads, ["key", "place"]).select(F.col("lead").alias("early"), F.col("at").alias("late"))
    inserted = longer.join(whole, "key").select(F.col("whole").alias("early"), F.col("at").alias("late"))
    deleted = leads.groupBy("key").agg(F.min("lead").alias("early")).join(whole, "key").select("early", F.col("whole").alias("late"))
    tried = replaced.union(inserted).union(deleted).where("early < late").select(F.col("early.form").alias("a"), F.col("late.form").alias("b")).distinct()
    return _near(tried, varied.select("form", "words")).select(F.col("b").alias("form")).distinct()


def dedup_lines(docs: DataFrame, *, max_edits: int = 1, min_words: int = 5, short_repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines, and ``n_lines``, ``n_removed``."""
    table = Carried(docs, id_col, text_col, ("n_lines", "n_removed"))
    owned, _ = own_keys(table.rows, "own", "id", "text")
    keyed = owned.select(F.col("own").alias("doc_id"), "text").where("text is not null")
    gone = stored(repeated_lines(keyed, max_edits=max_edits, min_words=min_words, short_repeats=short_repeats), "gone")
    some, others = perhaps_in(owned, "own", marks_of(gone, "doc_id"))
    found = some.hint("merge").join(gone, F.col("own") == F.col("doc_id"), "left").unionByName(others.withColumn("gone", F.lit(None).cast("array<int>")), allowMissingColumns=True)
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    rest = let(lines, lambda all_lines: F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long").alias("n_lines")
    found = found.select("id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"), "rest", n_lines, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return table.out(found, F.col("n_lines"), F.col("n_removed"))

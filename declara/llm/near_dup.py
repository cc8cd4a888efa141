"""Near-duplicate documents: fast similarity sketches, banding, exact check, components.

A document's set holds the distinct ``shingle``-word runs (with fewer words, the
whole sequence as one; without words it is empty and linked with nothing). The
sketch of a set has ``bands * rows`` coordinates. In round i every element is
hashed to a coordinate and a value i + v, 0 <= v < 1; after as many rounds as
there are coordinates, round i places all elements at coordinate i, so each
coordinate fills; the smallest value stays. Early rounds only matter where
coordinates are still empty, so rounds stop once all are filled. Two sets agree
at a coordinate with the probability of their Jaccard similarity, with
concentration over coordinates.

* Equal sets form classes (by a 128-bit digest); only their smallest ids go on.
* ``bands`` groups of ``rows`` coordinates give keys. With the defaults a pair at
  0.8 is missed with probability 6e-5, at 0.85 with 2e-7; tests measure it.
* Documents with a key in common are compared with the key's smallest id (so a
  group of n gives n - 1 candidates, not n * n / 2). Where a key still holds
  several components, and many documents outside the largest, its documents are
  compared with the smallest of another component, a few times; then all of them
  across components on full sets, in pairs of blocks of bounded size, which yield
  links only.
* A candidate of a hub goes on if the sketches, a byte a coordinate, agree often enough: a
  pair at the threshold fails that with a probability under 1e-9. Those that pass
  are confirmed on full sets, made from the texts of such documents alone; a
  hub's set is sent once to each portion of its partners, not with each.

Joins on keys that many rows share (a digest, a band) have a stored table of one
row a key on the other side, so adaptive execution can split them; groups are
only counted and reduced (min, max), never collected. Intermediate tables are
Parquet in the shared folder.

Defined results: null text is empty; rows that share a ``doc_id`` are documents
of their own and come after all others, so one of several equal rows is kept (a
component of such rows alone bears their common id); null ids are ignored for
links: such a row is with those of its very text, or else by itself; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marks_of, own_keys, perhaps_in, quoted, small_batches, stored
from .kept import Cache, held

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word runs. bytes.lower and bytes.split know ASCII only, as is wanted."""
    known = held("near_dup", lambda: Cache(200_000, xxhash.xxh3_64_intdigest))
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(words) - size + 1)
    runs = np.full(n, min(size, len(words)), np.uint64)
    for i in range(min(size, len(words))):
        runs = mixed(runs ^ words[i : i + n])
    return np.unique(runs)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """Fast similarity sketch: for each coordinate the smallest (round, value), as 64-bit numbers.

    Rounds are taken several at a time; those after the one that fills the last coordinate change nothing.
    """
    top = np.iinfo(np.uint64).max
    out = np.full(size, top, np.uint64)
    at_once = max(1, 8 * size // len(elements))
    for first in range(0, size, at_once):
        rounds = np.arange(first, min(first + at_once, size), dtype=np.uint64)
        h = mixed(elements ^ mixed(rounds)[:, None])
        place = (h & np.uint64(0xFFFF)) * np.uint64(size) >> np.uint64(16)
        value = (h >> np.uint64(16)) | (rounds << np.uint64(48))[:, None]
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        if out.max() < top:
            return out
    for i in np.flatnonzero(out == top):
        rounds = np.uint64(size + i)
        h = mixed(elements ^ mixed(np.array([rounds]))[0])
        out[i] = (h >> np.uint64(16)).min() | (rounds << np.uint64(48))
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = coordinates.reshape(bands, rows)
    keys = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 32))
    for r in range(rows):
        keys = mixed(keys ^ parts[:, r])
    return keys.view(np.int64)


def signatures(docs: DataFrame, *, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, sketch): the last three are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys, brief = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), shingle)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
                full = sketch(found, bands * rows) if len(found) else None
                keys.append(None if full is None else band_keys(full, bands, rows))
                brief.append(None if full is None else mixed(full).astype(np.uint8).tobytes())
            kinds = pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip((counts, digests, keys, brief), kinds))], names=["doc_id", "n_shingles", "digest", "keys", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest string, keys array<long>, sketch binary")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), shingle).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["id", "elements"])

    return docs.mapInArrow(run, "id long, elements binary")


def least_agreement(coordinates: int, percent: int) -> int:
    """Coordinates that a pair at the threshold agrees in, but for a probability under 1e-9 (6.2 deviations)."""
    p = percent / 100
    return max(1, int(coordinates * p - 6.2 * (coordinates * p * (1 - p)) ** 0.5))


def _rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(pairs: DataFrame, one: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in ``least`` coordinates, with the size n of b's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_rows_of(batch.column("xa"), width) == _rows_of(batch.column("xb"), width)).sum(axis=1) >= least
            yield batch.select(["a", "b", "n"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(one.select(F.col("id").alias("a"), F.col("sketch").alias("xa")), "a").join(one.select(F.col("id").alias("b"), F.col("sketch").alias("xb"), "n"), "b")
    return both.select("a", "b", "n", "xa", "xb").mapInArrow(run, "a long, b long, n long")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, portion: int = 1_000_000) -> DataFrame:
    """The pairs (a, b, n) whose full sets have the similarity, as links (a, b). docs: (doc_id, text).

    The partners b of each hub a are dealt into portions of about ``portion``
    elements, and portions into groups of about that size.
    """
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts, _ = perhaps_in(docs, "doc_id", marks_of(ids, "id"))
    sets = stored(_sets(texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), shingle), "sets")
    hubs = stored(pairs.groupBy("a").agg(F.sum("n").alias("n")).select("a", F.ceil(F.col("n") / portion).cast("int").alias("parts"), "n"), "hubs")
    groups = max(1, -(-(hubs.agg(F.sum("n")).first()[0] or 0) // portion))
    at = F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("at")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("a", "part", F.lit(None).cast("long").alias("b"), at, F.col("a").alias("id"))
    tails = pairs.join(hubs.select("a", "parts"), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int"))
    dealt = heads.union(tails.select("a", "part", "b", at, F.col("b").alias("id"))).join(sets, "id").select("at", "a", "part", "b", "elements")

    def run(group: pa.Table) -> pa.Table:
        a, part, b = (group.column(c).to_pylist() for c in ("a", "part", "b"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("elements").combine_chunks()]
        hub = {(x, p): s for x, p, y, s in zip(a, part, b, found) if y is None}
        keep = []
        for x, p, y, s in zip(a, part, b, found):
            if y is not None:
                common = len(np.intersect1d(hub[x, p], s, assume_unique=True))
                if 100 * common >= percent * (len(hub[x, p]) + len(s) - common):
                    keep.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in keep], pa.int64()), "b": pa.array([y for _, y in keep], pa.int64())})

    return dealt.groupBy("at").applyInArrow(run, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between components within a key. members: (key, id, label, size of the key).

    A key's members are dealt into blocks of about ``block``; each pair of blocks
    is a group of its own, whose size does not depend on the key's.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    dealt = members.withColumn("own", own).select("key", "id", "label", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label")
    dealt = dealt.join(sets, "id").select("key", "i", "j", "own", "id", "label", "elements")

    def run(group: pa.Table) -> pa.Table:
        ids, labels, own = (group.column(c).to_numpy() for c in ("id", "label", "own"))
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("elements").combine_chunks()]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sizes = np.array([len(x) for x in found])
        common = common_counts(found)
        link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
        link &= (labels[:, None] != labels[None, :]) & (ids[:, None] < ids[None, :])
        if i != j:
            link &= own[:, None] != own[None, :]
        a, b = np.nonzero(link)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many elements each two sets share, some elements at a time."""
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = counts[place] > 1
    column = np.cumsum(counts > 1)[place[shared]] - 1
    owner, out = owner[shared], np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, (start, start + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for all ids in ``links``(a, b). Alternates small-star and large-star."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.select("u", "v").union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(edges, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("id"), "label")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, label, hi, size, others): members of keys that hold several components; others: those outside the largest of them."""
    now = members.join(labels.withColumnRenamed("id", "lid"), F.col("id") == F.col("lid"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    now = stored(now, "labelled")
    parts = now.groupBy("key", "label").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.max("label").alias("hi"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    return stored(now.join(stored(keys, "open"), "key"), "open-members")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, block: int = 256, stars: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    docs = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    owned, shared_ids = own_keys(small_batches(docs), "own_key", nulls=False)
    docs = owned.select(F.col("own_key").alias("doc_id"), "text")
    width, least = bands * rows, least_agreement(bands * rows, percent)
    signed = stored(signatures(docs, shingle=shingle, bands=bands, rows=rows), "signatures")
    real = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    one = signed.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "keys", "sketch")
    one = stored(one, "one")
    keyed = one.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    # Members of keys that more than one class has.
    members = stored(keyed.join(stored(shared, "shared"), "key"), "members")
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(_confirmed(stored(_alike(pairs, one, width, least), "alike"), docs, shingle, percent), "links")
    labels = stored(components(links), "labels")
    left = _open(members, labels)
    for _ in range(stars):  # keys with many outside their largest component: another hub, from the component that has the largest label
        if left.where(F.col("others") > 8 * block).isEmpty():
            break
        hubs = stored(left.where((F.col("others") > 8 * block) & (F.col("label") == F.col("hi"))).groupBy("key").agg(F.min("id").alias("a")), "hubs")
        pairs = left.where("label <> hi").join(hubs, "key").select("a", F.col("id").alias("b")).distinct()
        links = links.union(stored(_confirmed(stored(_alike(pairs, one, width, least), "alike"), docs, shingle, percent), "links"))
        labels = stored(components(links), "labels")
        left = _open(members, labels)
    # Every pair across components that is left, in blocks, on full sets.
    ids = stored(left.select("id").distinct(), "ids")
    texts, _ = perhaps_in(docs, "doc_id", marks_of(ids, "id"))
    sets = stored(_sets(texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), shingle), "sets")
    found = stored(_across(left.select("key", "id", "label", "size"), sets, percent, block), "links")
    labels = stored(components(links.union(found)), "labels")
    # Only classes of several documents, or in a larger component, say more than each document's own id.
    named = classes.join(labels.withColumnRenamed("id", "lid"), F.col("id") == F.col("lid"), "left").where("copies > 1 or label < id")
    named = stored(named.select("digest", F.coalesce("label", "id").alias("component")), "named")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    for name in ("doc_id", "component_id") if shared_ids is not None else ():
        known = shared_ids.select(F.col("own_key").alias("known_key"), "own_id")
        out = out.join(known, F.col(name) == F.col("known_key"), "left").withColumn(name, F.coalesce("own_id", name)).drop("known_key", "own_id")
    return out

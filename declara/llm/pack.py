"""Token packing by minimum bin slack.

Each partition is read as a stream. Its documents are tokenized, pieces of a
whole sequence are cut from the front of long ones, and the remainders go to a
window of at most ``window`` documents. A full window is packed: the multiset
of remaining lengths is filled into sequences one at a time, each starting with
the longest remainder; a bitset subset-sum over the other lengths (counts split
in powers of two) finds the fill closest to capacity, and backtracking yields
how many of each length it takes. A slack that no subset fills is closed by
cutting a remainder, so sequences are full; what a partition has left at its
end is cut into sequences whose lengths are powers of two, which need no
padding either.

Nothing is shuffled, so no key can be hot and only a window is in memory;
sequence ids come from the partition and a counter, so a repeated task repeats
them. Ids are cached by word (white space and letter runs end this vocabulary's
tokens), in two generations of bounded size.

Defined results: null or empty text is its end id alone; repeated rows are
packed as often as they occur; an id may be of any type or null, and is carried
along; an empty table has no pieces; other columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import quoted, small_batches
from .kept import Cache, held

BIG = sys.byteorder == "big"
COUNTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Letters that lower-case one to one and are stable under NFC; then marks, but for the one of contractions.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
PROBES = ("Some words, and MORE (ünïts) -- ok!", "été l'an 12x ß ÿ", "")
#: In byte-level vocabularies a byte is its Latin-1 sign where that can be printed; the others are numbered from 256 on, in order.
_PRINTED = [b for b in range(256) if b in range(33, 127) or b in range(161, 173) or b >= 174]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class WordTokenizer:
    """Ids of a text, as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str, remembered: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Cache(remembered, self._chunk)
        # Another vocabulary, whose words are not made like this one's, takes texts whole.
        self.by_word = all(self._direct(x) == b"".join(map(self._chunk, x.split(" "))) for x in PROBES)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._direct(text)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def _chunk(self, chunk: str) -> bytes:
        """A word and the marks after it have ids of their own, and are remembered for other chunks."""
        if chunk.isascii() and chunk.isalpha() and chunk.islower():
            return _packed([t.id for t in self.model.tokenize(chunk)])
        m = PLAIN.match(chunk)
        if not m:
            return self._direct(chunk)
        word, marks = m[1].lower(), m[2]
        return self._run(word) if chunk == word else self.known[word] + (self.known[marks] if marks else b"")

    def _run(self, run: str) -> bytes:
        """Ids of one run of letters or marks, which the model's merges alone make, on the signs that stand for its bytes."""
        return _packed([t.id for t in self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_SIGNS))])

    def _direct(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if BIG:
        found.byteswap()
    return found.tobytes()


def fill(lengths: list[int], counts: Counter, room: int) -> Counter:
    """How many of each length to take so that the sum is as close to ``room`` as can be, not beyond.

    lengths: those with a count, in descending order.
    """
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, batch = min(counts[n], room // n), 1
        while left > 0:
            take = min(batch, left)
            grown = (reach | reach << n * take) & mask
            if grown != reach:
                steps.append((n, take, reach))
                reach = grown
            left, batch = left - take, batch * 2
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, Counter()
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            taken[n] += take
            total -= n * take
    return taken


class Packer:
    def __init__(self, first_id: int, capacity: int, window: int):
        self.next_id, self.capacity, self.window = first_id, capacity, window
        self.open: dict[int, list[tuple]] = defaultdict(list)  # pieces by length
        self.held = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= self.capacity:
            yield from self._sequence([(doc_id, ids, start, self.capacity)])
            start += self.capacity
        if tokens > start:
            self._hold((doc_id, ids, start, tokens - start))
        if self.held >= self.window:
            yield from self.pack(keep=self.window // 8)

    def _hold(self, piece: tuple) -> None:
        self.open[piece[3]].append(piece)
        self.held += 1

    def _take(self, n: int) -> tuple:
        piece = self.open[n].pop()
        if not self.open[n]:
            del self.open[n]
        self.held -= 1
        return piece

    def pack(self, keep: int = 0) -> Iterator[tuple]:
        total = sum(n * len(x) for n, x in self.open.items())
        while self.held > keep and total >= self.capacity:
            pieces = [self._take(max(self.open))]
            room = self.capacity - pieces[0][3]
            lengths = sorted(self.open, reverse=True)
            for n, take in fill(lengths, {n: len(self.open[n]) for n in lengths}, room).items():
                pieces += [self._take(n) for _ in range(take)]
                room -= n * take
            if room:  # no subset fits: cut a longer remainder (any shorter one would have fitted)
                doc_id, ids, start, length = self._take(min(n for n in self.open if n > room))
                pieces.append((doc_id, ids, start, room))
                self._hold((doc_id, ids, start + room, length - room))
            total -= self.capacity
            yield from self._sequence(pieces)

    def close(self) -> Iterator[tuple]:
        yield from self.pack()
        rest = [self._take(n) for n in sorted(self.open, reverse=True) for _ in range(len(self.open[n]))]
        left = sum(p[3] for p in rest)
        while left:
            size = 1 << left.bit_length() - 1
            pieces, room = [], size
            while room:
                doc_id, ids, start, length = rest.pop()
                used = min(length, room)
                pieces.append((doc_id, ids, start, used))
                if used < length:
                    rest.append((doc_id, ids, start + used, length - used))
                room -= used
            left -= size
            yield from self._sequence(pieces)

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, ids, start, length in pieces:
            yield doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, self.next_id, offset
            offset += length
        self.next_id += 1


def pack(docs: DataFrame, tokenizer_path: str | None = None, *, capacity: int = 4096, end_id: int = 2, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences; see the module."""

    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        else:
            path = tokenizer_path
        tokenizer = held(("pack", path), lambda: WordTokenizer(path))
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, window)
        end, rows, ids = end_id.to_bytes(4, "little"), [], pa.null()
        for batch in batches:
            ids = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows += packer.add(doc_id, tokenizer.encode(text.as_py() or "") + end)
                if len(rows) >= 20_000:
                    yield _batch(rows, ids)
                    rows = []
        rows += packer.close()
        if rows:
            yield _batch(rows, ids)

    return small_batches(docs).select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    first, *others = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(first, ids), *(pa.array(c, pa.int64()) for c in others)], names=["doc_id", *COUNTS])

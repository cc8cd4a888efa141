"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary; each language has a probability for
each piece. A text's words (runs of letters, lower-cased, with the vocabulary's
word mark in front) are scored by the forward algorithm, which sums over all
ways to segment a word into pieces:

    a[0] = 1,  a[j] = sum over pieces (i, j] of a[i] * p(piece)

and a text's log-likelihood is the sum over its words. Letters that no piece
covers have a floor probability of their own.

Training: expected piece counts (forward and backward over all segmentations)
of the word counts of each language, ``rounds`` times, with additive smoothing.
Those counts come from a sample of at most about ``per_language`` documents of
each language (a documented bound, by a hash of the id, so that it is the same
in every run); all their words count. The model holds a number per piece and
language.

The prediction reads nothing but the text. Its score is the posterior with
equal priors on the likelihood per word times ``min(words, 30)``, so that long
texts do not all saturate at 1.

Words are found in the same way to learn and to predict: runs of letters (the
Unicode category L) of the lower-cased text.

Defined results: null text, or one without a letter, is ``und`` with score 0;
labels of null text teach nothing; without any labelled text all is ``und``;
languages that tie are told by the first of their names; each row, equal ones
too, gives one row; texts of any length are scored whole; carried columns keep
their names, but for ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches
from .kept import held

WORDS = re.compile(r"[^\W\d_]+")
MARK = "▁"
FLOOR = 1e-9
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters, lower-cased."""
    out = []
    for word in WORDS.findall((text or "").lower()):
        if word.isalpha():
            out.append(word)
        else:  # with signs such as a superscript, which are no digits to the expression
            out += "".join(c if c.isalpha() else " " for c in word).split()
    return out


def vocabulary(path: str) -> list[str]:
    """The pieces whose text is lower case and letters, but for the word mark."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    all_of = (pieces.id_to_piece(i) for i in range(pieces.get_piece_size()))
    return sorted({p for p in all_of if p == p.lower() and p.removeprefix(MARK).isalpha()} | {MARK})


class Model:
    """For each language a probability of each piece; two more rows: the floor, and nothing."""

    def __init__(self, languages: list[str], pieces: list[str], probs: np.ndarray):
        self.languages, self.pieces = languages, pieces
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.probs = np.vstack([probs, np.full((1, probs.shape[1]), FLOOR), np.zeros((1, probs.shape[1]))])
        keys = np.array([_hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For words of one length, by start: (start, end, rows that have a piece there, their pieces)."""
        n, floor = codes.shape[1], len(self.pieces)
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * BASE + codes[:, j - 1]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if j == i + 1:
                    yield i, j, np.arange(len(codes)), np.where(hit, self.order[at], floor)
                elif len(rows := np.flatnonzero(hit)):
                    yield i, j, rows, self.order[at[rows]]

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (row) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        for n, rows, codes in by_length(words):
            if n > LONG:
                for r in rows:
                    out[r] = self.word(words[r])
                continue
            forward = np.zeros((n + 1, len(rows), len(self.languages)))
            forward[0] = 1.0
            shift, at = 0.0, 0
            for i, j, own, pieces in self.edges(codes):
                if i != at:
                    at = i
                    if not i % 8:  # scaled now and then, so that nothing underflows
                        scale = forward[i].copy()
                        shift = shift + np.log(scale)
                        forward[i : i + self.longest + 1] /= scale
                forward[j, own] += forward[i, own] * self.probs[pieces]
            out[rows] = np.log(forward[n]) + shift
        return out

    def word(self, word: str) -> np.ndarray:
        """The same for one word, at a cost that suits a very long one."""
        text, floor = MARK + word, self.probs[len(self.pieces)]
        window = [np.ones(len(self.languages))] + [0.0] * self.longest
        shift = np.zeros(len(self.languages))
        for i in range(len(text)):
            here = window[0]
            shift += np.log(here)
            window = [x / here for x in window]
            for size in range(1, min(self.longest, len(text) - i) + 1):
                piece = self.index.get(text[i : i + size])
                if piece is not None or size == 1:
                    window[size] = window[size] + (floor if piece is None else self.probs[piece])
            window = window[1:] + [0.0]
        return shift + np.log(window[0])


BASE = np.uint64(0x100000001B3)
LONG = 64


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c)) & (1 << 64) - 1
    return h


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """Groups of marked words of one length: their places and, unless they are very long, code points."""
    groups: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w) + 1].append(i)
    for n, places in sorted(groups.items()):
        codes = None
        if n <= LONG:
            text = "".join(MARK + words[i] for i in places)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(places), n).astype(np.uint64)
        yield n, np.array(places), codes


def learn(by_language: dict[str, Counter], pieces: list[str], *, rounds: int = 2, smoothing: float = 0.05) -> Model:
    """Expectation maximization; runs of over LONG letters teach nothing."""
    languages = sorted(by_language)
    start = np.array([10.0 ** -(2 + len(p)) for p in pieces])  # the same for all: short pieces first
    learned = np.repeat(start[:, None], len(languages), axis=1)
    for x, language in enumerate(languages):
        words = [w for w in by_language[language] if len(w) < LONG]
        counts = np.array([by_language[language][w] for w in words], float)
        for _ in range(rounds):
            model, total = Model([language], pieces, learned[:, x : x + 1]), np.zeros(len(pieces) + 2)
            for n, rows, codes in by_length(words):
                p, edges = model.probs[:, 0], list(model.edges(codes))
                forward, backward = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
                forward[0] = backward[n] = 1.0
                for i, j, own, at in edges:
                    forward[j, own] += forward[i, own] * p[at]
                for i, j, own, at in reversed(edges):
                    backward[i, own] += backward[j, own] * p[at]
                share = counts[rows] / np.maximum(forward[n], 1e-300)
                for i, j, own, at in edges:
                    total += np.bincount(at, share[own] * forward[i, own] * p[at] * backward[j, own], len(total))
            total = total[: len(pieces)] + smoothing
            learned[:, x] = total / total.sum()
    return Model(languages, pieces, learned)


def in_sample(fraction: Column, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < fraction * (1 << 20)


def train(labelled: DataFrame, pieces: list[str], *, per_language: int = 800, rounds: int = 2) -> Model:
    """labelled: (doc_id, text, lang). Texts are sampled whole."""
    usable = small_batches(labelled).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNDETERMINED))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model([], pieces, np.empty((len(pieces), 0)))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("language-words", dict)
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts.update((lang, w) for w in words_of(text.as_py()))
            langs, words = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    counted = usable.where(in_sample(share, F.col("doc_id"))).select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_language: dict[str, Counter] = {lang: Counter() for lang in sizes}
    for r in counted.toLocalIterator():  # bounded by the sample
        by_language[r["lang"]][r["word"]] = r["n"]
    return learn(by_language, pieces, rounds=rounds)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The ``carried`` columns (by default doc_id) with lang_pred and score, for every row."""
    carried = [c for c in carried or ["doc_id"] if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # pieces times languages
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*map(quoted, carried)).schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            found = list(scorer.texts(t.as_py() for t in batch.column(0)))
            told = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *told], names=[*carried, "lang_pred", "score"])

    return small_batches(docs).select(quoted(text_col).alias("text"), *(quoted(c).alias(f"carried_{i}") for i, c in enumerate(carried))).mapInArrow(run, f"{kinds}, lang_pred string, score double")


class Scorer:
    """Scores texts in portions of some ``portion`` letters; words are scored once while they are remembered."""

    def __init__(self, model: Model, portion: int = 1_000_000, remembered: int = 200_000):
        self.model, self.portion, self.remembered = model, portion, remembered
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)))

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        waiting, size = [], 0
        for text in texts:
            waiting.append(words_of(text) if self.model.languages else [])
            size += len(text or "")
            if size >= self.portion:
                yield from self._scored(waiting)
                waiting, size = [], 0
        yield from self._scored(waiting)

    def _scored(self, waiting: list[list[str]]) -> Iterator[tuple[str, float]]:
        if len(self.known) > self.remembered:
            self.known, self.rows = {}, self.rows[:0]
        new = list({w for words in waiting for w in words if w not in self.known})
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.rows = np.vstack([self.rows, self.model.words(new)])
        get = self.known.__getitem__
        for words in waiting:
            if not words:
                yield UNDETERMINED, 0.0
                continue
            mean = self.rows[np.fromiter(map(get, words), np.int64, len(words))].mean(axis=0)
            odds = np.exp((mean - mean.max()) * min(len(words), 30))
            yield self.model.languages[int(mean.argmax())], float(1.0 / odds.sum())


def _scorer(shared) -> Scorer:
    """The last model's, kept between tasks for its words."""
    return held(("language", hash(shared.value)), lambda: Scorer(pickle.loads(shared.value)))


def identify(docs: DataFrame, labelled: DataFrame, *, carried: list[str] | None = None, vocabulary_path: str | None = None, per_language: int = 800, rounds: int = 2) -> DataFrame:
    """Learn from ``labelled`` (doc_id, text, lang), then predict ``docs``."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    return predict(docs, train(labelled, vocabulary(vocabulary_path), per_language=per_language, rounds=rounds), carried=carried)

"""The whole pipeline against plain Python versions of its stages."""

import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("declara.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from declara.llm import language  # noqa: E402

SF = Path("/root/testdata/sf0.001")


def edits_at_most_one(a, b):
    """Word edit distance by the full table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + row
        for j, y in enumerate(b, 1):
            row[j] = min(row[j] + (x != y), row[j + 1] + 1, row[j - 1] + 1)
        row.pop()
    return row[len(b)] <= 1


def plain_lines(texts):
    places = [(doc, i, tuple(line.encode().lower().split())) for doc in sorted(texts) if texts[doc] is not None for i, line in enumerate(texts[doc].split("\n"))]
    places = [p for p in places if p[2]]
    first = {}
    for doc, i, words in places:
        first.setdefault(words, (doc, i))
    forms, near = [words for words in first if len(words) >= 5], set()
    for k, b in enumerate(forms):
        if any(abs(len(a) - len(b)) < 2 and (a[:1] == b[:1] or a[-1:] == b[-1:]) and edits_at_most_one(a, b) for a in forms[:k]):
            near.add(b)
    gone = defaultdict(set)
    for doc, i, words in places:
        if words in near or first[words] != (doc, i):
            gone[doc].add(i)
    out = {}
    for doc, text in texts.items():
        if not gone[doc]:
            out[doc] = text
        elif (rest := "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc])).strip():
            out[doc] = rest
    return out


def plain_near(texts):
    sets = {}
    for doc, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {doc: doc for doc in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {doc: x if at == y else at for doc, at in label.items()}
    return {doc: text for doc, text in texts.items() if label[doc] == doc}


def plain_clean(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in items:
        w = words(item)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(x) for x in windows}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {doc: text for doc, text in texts.items() if not hit(words(text))}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    told = language.identify(docs, docs.where("crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "text", "lang")).select("doc_id", "lang_pred", "score").collect()
    stays = {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(re.search(r"[^\W\d_]", start[i] or "") for i in stays) and len(stays) > 0.9 * len(start)
    lined = plain_lines({i: t for i, t in start.items() if i in stays})
    single = plain_near(lined)
    clean = plain_clean(single, items)
    assert len(start) >= len(stays) > len(lined) and len(single) >= len(clean) > 0

    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(SF)).collect()]
    assert {p["doc_id"] for p in pieces} == {i for i in clean}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc, text in clean.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
            at += p["length"]
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096


def test_rows_without_own_ids(spark, tmp_path):
    """Null ids and repeated rows are judged like all others."""
    words = lambda k, n: " ".join(f"{chr(97 + k)}{i}w" for i in range(n))
    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(None, f"x {passage} y"), (None, words(0, 40)), (1, words(0, 40)), (2, words(1, 40)), (2, words(1, 40)), (3, words(2, 40)), (3, words(3, 40)), (None, words(4, 40))]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in data], "doc_id long, text string, n_chars long")
    once = sorted([data[0], *data[2:4], *data[5:]], key=str)
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert told(corpus_pipeline.lines(spark, docs, str(tmp_path))) == once
    assert told(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))) == once
    assert told(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted(data[1:], key=str)


def test_odd_rows(spark, tmp_path):
    """Each stage on nulls, empty and long texts, columns with names that stages use, and no rows at all."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{i}" for i in range(50_000))
    data = [(1, None, "en"), (2, "", "en"), (3, "\n \n", None), (4, long, "en"), (5, "the cat sat on the mat and it was there", "en"), (6, "12 34", "de"), (7, "x " + "one two three four five six seven eight nine ten", "en")]
    names = ("id", "key", "rest", "gone", "own", "score", "lang_pred", "n_lines", "kept", "row_key", "digest", "n_removed", "seeds", "doc")
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").select("*", *(spark_lit(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        ids = sorted({r["doc_id"] for r in got.select("doc_id").collect()})
        assert none.isEmpty()
        if name != "packing":
            assert got.columns == none.columns == docs.columns
        assert set(ids) <= set(range(1, 8)) and ids == {"language": ids, "decontamination": [1, 2, 3, 4, 5, 6]}.get(name, [1, 2, 3, 4, 5, 6, 7])
        if name == "language":
            assert not {1, 2, 3, 6} & set(ids) and 5 in ids


def spark_lit(name):
    from pyspark.sql import functions as F

    return F.lit("x").alias(name)

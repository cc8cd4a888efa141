import gzip
import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("declara.llm")

from pyspark.sql import functions as F  # noqa: E402

from declara.llm import chat, decontaminate, fingerprint, language, lines, near_dup, pack, pii, secrets, warc  # noqa: E402

DOCS = "doc_id long, text string"
rng = np.random.default_rng(5)
VOCAB = ["".join(rng.choice(list("abcdeé"), rng.integers(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


def rows(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=str)


def awkward(spark):
    """Nulls, empty and blank texts, ties, a long text and a clashing extra column."""
    long = prose(30_000)
    data = [(1, None), (2, ""), (3, "  \n "), (4, "Same Text here is five words"), (5, "Same Text here is five words"), (6, long), (7, long + " more"), (None, "no id"), (8, "ÉÀ ß 123 </s>")]
    return spark.createDataFrame(data, DOCS).withColumn("seeds", F.lit(1)).withColumn("key", F.lit("x"))


def test_decontaminate(spark):
    items = [(1, prose(14)), (2, "Only four short words"), (3, ""), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    window = " ".join(items[0][1].split()[2:12])
    docs = awkward(spark).select("doc_id", "text").union(spark.createDataFrame([(20, f"x, y {window.upper().replace('É', 'é')}. z"), (21, "a ONLY four, short words b only four short"), (22, window[: len(window) - 6])], DOCS))
    for limit in (64_000_000, 0):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()}
        assert len(got) == docs.count()
        assert (got[20]["n_hit"], got[20]["items"]) == (10, ["1"]) and (got[21]["n_hit"], got[21]["items"]) == (4, ["2"])
        assert all(got[i]["n_hit"] == 0 for i in (1, 2, 3, 4, 22)) and got[1]["n_words"] == 0 and got[4]["n_words"] == 6
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.decontaminate(docs.limit(0), bench).isEmpty()


def test_chat(spark):
    turns = [(1, 0, "user", "</s>[INST] ok [/INST] \\ \\n <\\s>"), (1, 1, "assistant", "a</s\n<s>b"), (1, 2, None, None), (1, 2, "odd\nrole\\n", "é"), (2, 0, "system", ""), (None, 0, "user", "x" * 10_000)]
    out = chat.format_chats(chat.canonical(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    back = {r["conv_id"]: r for r in out.select("conv_id", chat.parse_chat(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [tuple(t) for t in back[1]["t"]] == [("user", turns[0][3]), ("assistant", turns[1][3]), ("", ""), ("odd\nrole\\n", "é")]
    assert back[1]["loss"] == turns[1][3] and back[2]["loss"] == "" and len(back) == 3
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"prompt":"q","completion":"a","more":1}', '{"instruction":"q","input":"","output":"a"}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}', '{"instruction":"q","input":null,"output":"a","text":"all of it"}',
        '{"instruction":"q","output":"a"}', '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"prompt":"other"}', '{"question":"q","answer":"a","turn":1}',
        '{"instruction":"q","context":"","response":"a","category":"x"}', '{"messages":[{"role":"user"},{"role":"assistant","content":"a"}]}', '{"prompt":"q","completion":null}', '{"messages":[],"id":3}',
    ]
    df = spark.createDataFrame(list(enumerate([*records, '{"z":1}', "no json", None])), "i long, raw string")
    made = {r["conv_id"]: r for r in chat.format_chats(chat.from_records(df, "i", "raw")).collect()}
    assert {made[i]["formatted"] for i in range(10)} == {"<s>user\nq</s><s>assistant\na</s>"}
    assert made[10]["formatted"] == "<s>user\n</s><s>assistant\na</s>" and made[11]["formatted"] == "<s>user\nq</s><s>assistant\n</s>"
    assert made[12]["layout"] == "no_messages" and made[12]["n_turns"] == 0
    assert all(made[i]["layout"] == "unknown" and made[i]["n_turns"] == 0 for i in (13, 14, 15)) and made[13]["raw"] == '{"z":1}' and made[3]["raw"] is None
    again = spark.createDataFrame([(None, records[0]), (None, records[1]), (5, records[0]), (5, records[2])], "i long, raw string")
    assert [r["n_turns"] for r in chat.format_chats(chat.from_records(again, "i", "raw")).collect()] == [2] * 4
    table = spark.createDataFrame([(1, "q", "a", "x"), (2, "q", None, "x")], "conv_id long, prompt string, completion string, role string")
    assert rows(chat.format_chats(chat.canonical(table)), "conv_id", "formatted") == [(1, "<s>user\nq</s><s>assistant\na</s>"), (2, "<s>user\nq</s><s>assistant\n</s>")]


def test_pii(spark):
    texts = ["mail Bob.x42@Mail8.example.com, +1 (514) 555-8389; 514-555-8389; 4111 1111 1111 1111 10.2.3.4.", "again bob.x42@mail8.example.com and 4111111111111112", "Mr. John Smith, Frau Anna; DE89 3704 0044 0532 0130 00, 078-05-1120, v1.2.3.4.5", None, "", "clean text 12"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("surrogate", F.lit(1))
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    assert [got[i]["text"] for i in (3, 4, 5)] == texts[3:] and [got[i]["n_entities"] for i in range(6)] == [5, 1, 4, 0, 0, 0]
    address = re.search(r"\S+@\S+\.example", got[0]["text"])[0]
    assert address in got[1]["text"] and "4111111111111112" in got[1]["text"] and "v1.2.3.4.5" in got[2]["text"] and "bob" not in got[1]["text"]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[0]["text"])[0]
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(card.replace(" ", "")))) % 10 == 0
    many = spark.range(3000).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("value"))
    assigned = pii.assign(many, "k").cache()  # 10000 surrogates for 3000 values: draws collide
    assert assigned.count() == 3000 == assigned.select("surrogate").distinct().count()
    assert assigned.join(many.select(F.col("value").alias("v")), F.col("surrogate") == F.col("v")).isEmpty()


def test_pack(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    df = awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    got = pack.pack(df, capacity=256, window=4).collect()
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for d in ids:
        assert sorted(i for r in got if r["doc_id"] == d for i in range(r["start"], r["start"] + r["length"])) == list(range(len(ids[d])))
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 256 or n & (n - 1) == 0 for n in by.values())
    words = pack.WordTokenizer(public.path("word_bpe_49k.json"))
    for text in ("İstanbul ΣΑΣ don't ﬁ é <|endoftext|> x1,2\x1f\x85　", "HÉLLO!! l'Été 12ab"):
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_fill():
    lengths = [int(x) for x in rng.integers(1, 60, 12)]
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums}
    counts = Counter(lengths)
    for room in range(0, 200, 7):
        taken = pack.fill(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in taken.items())


def plain_components(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_near_duplicates(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "Same text", 5: "same TEXT", 6: "same text more"}
    base = prose(120).split()
    for i in range(60):  # a family around one text, near and less near
        w = list(base)
        for j in rng.integers(0, 120, i % 9):
            w[j] = "edit%d" % rng.integers(1000)
        texts[100 + i] = " ".join(w)
    for i in range(40):
        texts[200 + i] = prose(50)
    df = spark.createDataFrame(list(texts.items()), DOCS).withColumn("id", F.lit(1))
    for shingle, block in ((4, 256), (5, 8)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, shingle=shingle, block=block).collect()}
        assert got == plain_components(texts, shingle, 80)
    assert near_dup.near_duplicates(df.limit(0)).isEmpty()


def test_sketch():
    agree = []
    for _ in range(30):
        both, one = rng.integers(0, 2**62, 400).astype(np.uint64), rng.integers(0, 2**62, 100).astype(np.uint64)
        a, b = near_dup.sketch(np.unique(both), 192), near_dup.sketch(np.unique(np.concatenate([both, one])), 192)
        agree.append((a == b).mean())
    assert abs(np.mean(agree) - 0.8) < 0.03
    assert (near_dup.sketch(np.array([7], np.uint64), 192) < np.iinfo(np.uint64).max).all()


def test_warc(spark):
    pages = [(None, "u", "a"), (3, None, "a"), (4, "v\r\nx", None), (5, "v", ""), (5, "v", ""), (6, "w", "é" * 5000), (9, "w", "é" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    got = rows(warc.round_trip(df), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == sorted([(None, 1, "response", None), (3, 1, "revisit", None), (4, 0, "response", None), (5, 0, "revisit", 4), (5, 0, "revisit", 4), (6, 10000, "response", None), (9, 10000, "revisit", 6)], key=str)
    assert warc.round_trip(df, least_bytes=2).where("record_type = 'revisit'").count() == 1
    assert warc.round_trip(df.limit(0)).isEmpty()
    assert rows(warc.round_trip(df, per_package=2), "page_id", "payload_bytes", "record_type", "refers_to") == got
    for force64 in (False, True):
        f = io.BytesIO()
        warc.write_package(f, [({"url": f"http://b.a/{i % 7}"}, b"r%d" % i * i) for i in range(50)], force64=force64)
        assert zipfile.ZipFile(f).testzip() is None and sorted(r for _, r in warc.read_package(f)) == sorted(b"r%d" % i * i for i in range(50))
        lines = zipfile.ZipFile(f).read("indexes/index.cdxj").decode().splitlines()
        assert lines == sorted(lines) and all(x.startswith("a,b)/") for x in lines)
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"nothing"))


def foreign(index="indexes/index.cdx.gz", method=zipfile.ZIP_STORED, **more):
    """A package as other tools make them: two archives, one not gzipped, text before the key's JSON, members in another order."""
    made = [warc.record(i, f"http://h/{i}", b"p%d" % i, 2, warc.base32_sha1(b"p%d" % i), None, False) for i in range(6)]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    one, two, lines = b"", b"", []
    for i, raw in enumerate([info, *made[:3]]):
        data = gzip.compress(raw)
        if i:
            lines.append(f'h)/{i - 1} 20240101000000 {{"url": "http://h/{i - 1}", "offset": "{len(one)}", "length": "{len(data)}", "filename": "one.warc.gz"}}')
        one += data
    for i, raw in enumerate(made[3:], 3):
        lines.append(f'h)/{i} 20240101000000 {{"offset": {len(two)}, "length": {len(raw)}, "filename": "two.warc"}}')
        two += raw
    lines += more.get("lines", [])
    text = "".join(f"{x}\n" for x in lines).encode()
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", method) as z:
        z.writestr("pages/pages.jsonl", "{}")
        if index:
            z.writestr(index, gzip.compress(text[:100]) + gzip.compress(text[100:]) if index.endswith("gz") else b"!meta 0 {}\n" + text)
        z.writestr("archive/two.warc", two)
        z.writestr("archive/one.warc.gz", one)
    return f, made, info


def test_foreign_packages(spark, tmp_path):
    for index in ("indexes/index.cdx.gz", "indexes/index.cdxj"):
        f, made, _ = foreign(index)
        assert sorted(r for _, r in warc.read_package(f, at_once=2)) == made
    f, made, info = foreign(None)
    assert sorted(r for _, r in warc.read_package(f)) == sorted([info, *made])
    for bad in ({"method": zipfile.ZIP_DEFLATED}, {"lines": ['x 1 {"offset": 0, "length": 99999, "filename": "two.warc"}']}, {"lines": ["com,x)/ 2024 text/html"]}, {"lines": ['x 1 {"offset": 0, "length": 1, "filename": "no.warc"}']}):
        with pytest.raises(ValueError):
            list(warc.read_package(foreign(**bad)[0]))
    (tmp_path / "x.wacz").write_bytes(f.getvalue())
    got = warc.read_archives(spark.createDataFrame([(f"{tmp_path}/x.wacz",)], "path string")).collect()
    assert sorted(r["record_type"] for r in got) == ["response"] * 6 + ["warcinfo"] and {bytes(r["payload"]) for r in got} == {b"a: b", *(b"p%d" % i for i in range(6))}
    with pytest.raises(ValueError):
        warc._told(warc.parse(made[0].replace(b"p0", b"zz")))


def test_language(spark):
    pieces = ["▁", *"abcdefgh", "▁ab", "cd", "abc", "▁gh"]
    model = language.learn({"x": Counter({"abcd": 5, "cdcd": 2}), "y": Counter({"ghgh": 4, "efgh": 3})}, pieces)

    def every(word, k):
        text, total = "▁" + word, 0.0

        def walk(at, p):
            nonlocal total
            if at == len(text):
                total += p
            for end in range(at + 1, len(text) + 1):
                i = model.index.get(text[at:end])
                q = model.probs[i, k] if i is not None else language.FLOOR if end == at + 1 else 0
                if q:
                    walk(end, p * q)

        walk(0, 1.0)
        return np.log(total)

    for word in ("abcd", "ghabc", "zab", "h" * 70):
        assert np.allclose(model.words([word])[0], model.word(word))
    assert np.allclose(model.word("abcdgh"), [every("abcdgh", k) for k in range(2)])
    df = spark.createDataFrame([(1, "abcd cd"), (2, "gh ef"), (3, None), (4, "12 !"), (5, "")], DOCS)
    got = rows(language.predict(df, model), "doc_id", "lang_pred")
    assert got == [(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und")]
    none = language.train(df.withColumn("lang", F.lit(None).cast("string")), pieces)
    assert rows(language.predict(df, none), "lang_pred") == [("und",)] * 5


def test_held_out(spark):
    from declara.llm.q_language import op7_language

    sf = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = op7_language(spark, sf).join(truth, "doc_id").where("held_out and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count() > 0


def test_lines(spark):
    line = prose(30)
    w = line.split()
    variants = [line.replace("a", "A"), " ".join(w[:7] + w[8:]), " ".join(w[:3] + ["new"] + w[3:]), " ".join(w[:-1] + ["other"])]
    far = " ".join(w[:3] + ["one", "two"] + w[5:])
    texts = [(1, f"head\n{line}\nhead"), (2, "\n".join(["head", *variants, far])), (3, None), (4, ""), (5, "a b c d\na b c d"), (6, prose(5000))]
    df = spark.createDataFrame(texts, DOCS).withColumn("form", F.lit(1))
    got = {r["doc_id"]: r for r in lines.dedup_lines(df, short_repeats=False).collect()}
    assert got[1]["text"] == texts[0][1] and got[2]["text"] == f"head\n{far}" and got[2]["n_removed"] == 4
    assert [got[i]["text"] for i in (3, 4, 5, 6)] == [t for _, t in texts[2:]]
    assert lines.dedup_lines(df, max_edits=0, short_repeats=False).agg(F.sum("n_removed")).first()[0] == 1
    with pytest.raises(ValueError):
        lines.dedup_lines(df, max_edits=2)
    words = [x.encode() for x in w]
    for i in range(30):
        assert set(lines.variants(words)) & set(lines.variants(words[:i] + words[i + 1 :]))
        assert set(lines.halves(words)) & set(lines.halves(words[:i] + words[i + 1 :])) and set(lines.halves(words)) & set(lines.halves(words[:i] + [b"zz"] + words[i + 1 :]))


def test_lines_of_one_key(spark):
    """Many lines around one base, with repeated words, against all earlier lines one by one."""
    base = "aa aa bb cc aa dd dd".split()
    made = [base[:i] + [w] + base[i + 1 :] for i in range(7) for w in ("aa", "dd", "x", "y")]
    made += [base[:i] + [w] + base[i:] for i in range(8) for w in ("aa", "x", "z")] + [base[:i] + base[i + 1 :] for i in range(7)] + [base]
    made = [made[i] for i in rng.permutation(len(made))]
    for order in (made, made[::-1]):
        forms = [[w.encode() for w in words] for words in order]
        want = [int(any(lines.near(x, y, 1) for x in forms[:i])) for i, y in enumerate(forms)]
        df = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(order)], DOCS)
        assert [r["n_removed"] for r in lines.dedup_lines(df).orderBy("doc_id").collect()] == want


def test_secrets():
    body = "z1" * 15
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        check = secrets.BASE62[d] + check
    good = f"ghp_{body}{check}"
    text = f"É PassWord = 'abc12' token:{'x' * 6} AKIA{'A' * 16} {'0f' * 12} {good} {good[:-1]}! apikey=token=secret9"
    kinds = [k for k, _, _ in secrets.scan(text)]
    assert kinds.count("issued") == 1 and kinds.count("access") == 1 and kinds.count("hex") == 1 and kinds.count("assign") == 2
    assert secrets.scan(None) == secrets.scan("") == []
    token = "eyJhbGciOiAieCJ9.aa.bb"
    assert secrets.scan(f"xEYjx{token}") == [("web", 5, 5 + len(token))] and secrets.scan(f"eyJeyJ{token}x") == secrets.scan("eyJeyJ" * 9) == []
    plain = {
        "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    parts = ["token", "=", " ", "secret", ":", "abcdef12", "AKIA", "Z9" * 9, "é", "0123456789abcdef", "api_KEY", '"', "ſecret", "-"]
    for _ in range(400):
        text = "".join(rng.choice(parts, 25))
        want = sorted((m.start(), list(plain).index(k), m.end()) for k, (p, ok) in plain.items() for m in p.finditer(text) if ok(m))
        assert [(s, secrets.ORDER[k], e) for k, s, e in secrets.scan(text) if k in plain] == want


def test_fingerprints(spark):
    df = awkward(spark)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, per_range=2).collect()}
    order = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(order)
    for (d, text), (_, following) in zip(order, order[1:] + order[:1]):
        n = len(text) // 4
        assert got[d]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest() and got[d]["n_chars"] == len(text)
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0 and got[1]["near_next"] == 1.0
    errors = []
    for _ in range(40):
        a, b = prose(200), prose(200)
        b = a[:600] + b
        x, y = Counter(a.lower().split()), Counter(b.lower().split())
        errors.append(fingerprint.likeness(fingerprint.signature(a, 64), fingerprint.signature(b, 64)) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert fingerprint.fingerprints(df.limit(0)).isEmpty()


def test_fingerprint_terms_stay_apart():
    """Texts of over 30k distinct words: different words must not become one term."""
    n, samples = 40_000, 2048
    word = lambda i: f"w{i}"
    a = " ".join(map(word, range(n)))
    for shared in (0, n // 4, n // 2):
        b = " ".join(map(word, range(n - shared, 2 * n - shared)))
        expected = shared / (2 * n - shared)
        got = fingerprint.likeness(fingerprint.signature(a, samples), fingerprint.signature(b, samples))
        assert abs(got - expected) < 4 * (expected * (1 - expected) / samples) ** 0.5 + 0.002
    # Counts above one, so that the draws of d and q count too.
    counts = rng.integers(1, 9, n), rng.integers(1, 9, n)
    texts = [" ".join(f"{word(i)} " * c for i, c in enumerate(cs)) for cs in counts]
    expected = np.minimum(*counts).sum() / np.maximum(*counts).sum()
    got = fingerprint.likeness(*(fingerprint.signature(t, samples) for t in texts))
    assert abs(got - expected) < 4 * (expected * (1 - expected) / samples) ** 0.5


def test_pii_phones_and_names(spark):
    phones = ["+49 30 1234567", "+33 1 42 68 53 00", "06 12 34 56 78", "+34 912 345 678", "020 7946 0958", "5145558389", "+44 (0)20 7946 0958", "0049 30 1234567", "(030) 1234567", "0171/1234567", "06.12.34.56.78", "612 34 56 78", "+15145558389", "1-514-555-8389"]
    persons = ["Mr. McDonald", "Mr. Jean-Luc Picard", "Mrs. Anna Maria Smith", "Mr. O'Brien", "Señor Ortega y Gasset", "Herr von der Leyen", "Mr. John F. Kennedy", "Madame d'Arc", "Mr.Smith", "Господин Римский-Корсаков"]
    left = ["on 01.02.2024 10:30", "pi 3.5145558389", "1700000000 s", "ISBN 978-0-306-40615-7", "id 051455583890123", "2024-01-02 03:04:05", "Frau des Hauses", "5145558389.50"]
    texts = [f"call {x}, please" for x in phones] + [f"saw {x}'s cat, then" for x in persons] + left + ["Mr. Smith; Mr Smith; Mr. Smith's", "Mr. Smith Mrs. Jones", "+33 1 42 68 53 00 2024 5.6.7.8"]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOCS), "k").collect()}
    for i, x in enumerate(phones):
        assert got[i]["n_entities"] == 1 and x not in got[i]["text"], x
        assert re.sub("[0-9]", "9", got[i]["text"]) == re.sub("[0-9]", "9", texts[i]), x
    for i, x in enumerate(persons, len(phones)):
        title = re.match(r"\w+\.? ?", x)[0]
        assert got[i]["n_entities"] == 1 and re.fullmatch(rf"saw {re.escape(title)}\w+( \w+)?'s cat, then", got[i]["text"]), got[i]["text"]
        assert not set(re.findall(r"\w{3,}", x[len(title) :])) & set(re.findall(r"\w+", got[i]["text"])), got[i]["text"]
    for i, x in enumerate(left, len(phones) + len(persons)):
        assert got[i]["text"] == x and got[i]["n_entities"] == 0, got[i]["text"]
    same, two, apart = (got[len(texts) - n] for n in (3, 2, 1))
    first = re.match(r"Mr\. (\w+); ", same["text"])[1]
    assert same["text"] == f"Mr. {first}; Mr {first}; Mr. {first}'s" and first != "Smith"
    assert two["n_entities"] == 2 and apart["n_entities"] == 2 and " 2024 " in apart["text"]
    assert got[0]["text"].startswith("call +49 ") and got[2]["text"].startswith("call 0") and got[6]["text"].startswith("call +44 (0)")


def test_short_lines(spark):
    df = spark.createDataFrame([(1, "All rights reserved.\n\nx"), (2, "all  RIGHTS reserved.\nall rights\n\ny"), (3, "a b c d e\na b c d")], DOCS)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert got == {1: "All rights reserved.\n\nx", 2: "all rights\n\ny", 3: "a b c d e\na b c d"}


def test_lines_of_shared_ids(spark):
    """Texts that share an id, or have none, are judged each by itself."""
    a, b, c = prose(12), prose(14), prose(16)
    df = spark.createDataFrame([(1, a), (2, f"{a}\nx"), (2, f"{b}\ny"), (3, c), (None, c), (None, prose(18)), (5, prose(20))], DOCS)
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(df).collect()), key=str)
    want = [(d, t, 0) for d, t in ((r["doc_id"], r["text"]) for r in df.collect())]
    want[1], want[4] = (2, "x", 1), (None, "", 1)
    assert got == sorted(want, key=str)
    top = spark.createDataFrame([(2**63 - 1, a), (-(2**63), b), (None, c), (None, c)], DOCS)
    assert sorted(r["n_removed"] for r in lines.dedup_lines(top).collect()) == [0, 0, 0, 1]


def test_decontaminate_shared_ids(spark):
    passage, other = "one two three four five six seven eight nine ten", prose(20)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {passage}"), (1, other), (None, f"{passage} y z"), (None, "clean"), (None, None)], DOCS)
    for limit in (64_000_000, 0):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()), key=str)
        assert got == sorted([(1, 11, 10), (1, 20, 0), (None, 12, 10), (None, 1, 0), (None, 0, 0)], key=str)


def test_near_duplicates_shared_ids(spark):
    """A text that shares its id with another still links those it is like."""
    a, b = prose(60), prose(60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(60)), (4, prose(60)), (None, prose(60))], DOCS)
    got = near_dup.near_duplicates(df).select("doc_id", "component_id", "kept")
    assert rows(got, "doc_id", "component_id", "kept") == sorted([(1, 2, False), (1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (None, None, True)], key=str)

"""The operators on small tables: brute force, edge cases, round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamella.llm import bpe, chat, decontaminate, graph, line_dedup, passages, quality, secrets, simhash, token_files, warc
from lamella.llm._common import fresh_path

WORDS = "the of Étion ion ÉCOLE don't 12 x1 password token=abc ab;c über naïve <|endoftext|> #   日本語".split(" ")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, `key` string, `Drop` string"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def texts() -> list[str | None]:
    rng = random.Random(3)
    made = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(30)]
    lines = ["  Shared LINE ", "shared line", "Other", "", "\t", "Été"]
    made += ["\n".join(rng.choices(lines, k=rng.randint(1, 6))) + f"\nown {i}" for i in range(25)]
    long = " ".join(rng.choices(WORDS, k=20_000))
    copy = " ".join(f"w{i}" for i in range(120))
    return [*made, None, "", " ", "\n", "a" * 30_000, long, copy, copy, copy.replace("w60", "zz"), copy.upper(), "x  y\r\n\tz ", "\0 a\0b", "1 2 3"]


@pytest.fixture(scope="module")
def docs(spark):
    """Ids with a null, repeated rows, rows of one id with two texts, nulls in all columns, and columns with clashing names."""
    rows = [(i, t, ["en", "fr", None, "zz"][i % 4], None if i % 5 else "s", len(t) if t else None, i, "k", None) for i, t in enumerate(texts())]
    rows += [(None, "null id text here", None, None, None, None, None, None), rows[3], rows[3], (5, "the same id with another text", "en", "s", 1, 1, "k", "d")]
    return spark.createDataFrame(rows, SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same(found, expected):
    assert Counter(map(tuple, found)) == Counter(expected)


# ---- bpe
def test_bpe_is_as_the_library(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path(bpe.DEFAULT_VOCABULARY))
    expected = []
    for i, text in local(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        expected.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))))
    same(bpe.round_trip(docs).collect(), expected)
    assert bpe.round_trip(empty(spark)).collect() == []
    encoded = bpe.encode(docs)
    same(bpe.decode(encoded).collect(), [(i, x) for i, x in local(docs)])


def test_bpe_matrix_array_and_heap_agree():
    b = bpe.loaded(bpe.DEFAULT_VOCABULARY)
    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choices(b"abcdehinorst ", k=rng.randint(1, 30)))
        out = {}
        b.matrix([w], out)
        assert np.frombuffer(out[w], dtype="<u4").tolist() == b.array(w) == b.heap(w)


# ---- token files
def test_token_files_round_trip(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path(token_files.DEFAULT_VOCABULARY))
    folder = fresh_path(spark, "test-tokens")
    manifest = token_files.write(docs, folder, length=64, rows=4, shard_bytes=20_000)
    assert manifest.count() > 1
    start, expected = 0, []
    for i, text in sorted(local(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    same(token_files.read_index(spark, manifest, folder).collect(), expected)
    shard = token_files.Shard(folder, 0)
    ids, mask = shard.sequence(1)
    assert len(ids) == len(mask) == 64 and (ids == shard.ids(64, 64)).all() and not ids.flags.owndata
    folder = fresh_path(spark, "test-tokens")
    assert token_files.read_index(spark, token_files.write(empty(spark), folder), folder).collect() == []


# ---- quality
def test_quality_base(docs, spark):
    expected = []
    for i, text in local(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(w)
        grams = Counter(tuple(w[k : k + 5]) for k in range(n - 4))
        hit = {p for k in range(n - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((i, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n))
    found = quality.measure(docs)
    same(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), expected)
    assert found.where("base_failed and kept").count() == 0
    assert quality.keep(docs).columns == docs.columns and quality.keep(docs).count() == found.where("kept").count()
    assert quality.measure(empty(spark)).collect() == []


def test_quality_fertility_rejects_noise(spark):
    rng = random.Random(2)
    clean = " ".join(rng.choices("when people read books they often learn about history and science from many authors".split(), k=13)) + " " + " ".join(f"chapter {i} tells of place{i} and year{i}" for i in range(30))
    noise = " ".join("".join(chr(rng.randrange(0x2500, 0x2BFF)) for _ in range(8)) for _ in range(120))
    rows = spark.createDataFrame([(1, clean, "en"), (2, noise, "en"), (3, noise, None)], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in quality.measure(rows).collect()} == {1: True, 2: False, 3: True}


def brute_fertility(text, lang, model):
    """The verdict of the bands by plain counts."""
    ids = [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in model.encode(w)]
    if not ids:
        return True
    n, counts = len(ids), Counter(ids)
    lettered = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text) if re.search(r"[A-Za-z]|[^\0-\x7f]", w)]
    m = sum(len(model.encode(w)) for w in lettered)
    chars = sum(map(len, lettered)) / max(1, m)
    share = sum(c for i, c in counts.items() if model.is_byte(i)) / n
    entropy = -sum(c / n * np.log2(c / n) for c in counts.values())
    if lang in quality.BANDS:
        band = quality.BANDS[lang]
    else:
        letters = {name: len(re.findall(f"[{r}]", text)) for name, r in quality.SCRIPTS.items()}
        most = max(letters.values())
        band = quality.BANDS.get(next((k for k, v in letters.items() if v == most and most), ""), quality.Band())
    low, high = band.least_chars - 1.5 / max(1, m) ** 0.5, band.most_chars + 1.5 / max(1, m) ** 0.5
    return (not m or low <= chars <= high) and share <= band.most_bytes and entropy >= min(band.least_entropy, np.log2(n) / 2) - 1e-9


def test_quality_verdict_against_brute_force(docs, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(quality.DEFAULT_PIECES))
    rng = random.Random(14)
    made = [" ".join("".join(rng.choices(a, k=rng.randint(3, 12))) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnop0123456789", "абвгдежзик", "日本語学校生", "ab") for n in (10, 12, 30, 200)]
    rows = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(2000 + i, t, ("en", "de", None, "fr")[i % 4]) for i, t in enumerate(made)], "doc_id bigint, text string, lang string"))
    failed = {(r["doc_id"], r["n_words"], r["word_chars"]): (r["base_failed"], r["kept"]) for r in quality.measure(rows).collect()}
    verdicts = set()
    for r in rows.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        base, kept = failed[r["doc_id"], len(words), sum(map(len, words))]
        assert kept == (not base and brute_fertility(r["text"] or "", r["lang"], model)), r
        verdicts.add((base, kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr"])
def test_quality_bands_part_noise_from_text(spark, lang):
    """All long texts of random letters go, and nearly no text of the corpus that passes the base rules."""
    rng = random.Random(15)
    noise = [" ".join("".join(rng.choices(a, k=rng.randint(3, 10))) for _ in range(120)) for a in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(50)]
    assert quality.keep(spark.createDataFrame([(t, lang) for t in noise], "text string, lang string")).count() == 0
    clean = quality.measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("lang") == lang)).where("not base_failed")
    assert clean.where("kept").count() >= 0.99 * clean.count() > 0


# ---- line dedup
def brute_lines(rows, least):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    counts = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    for i, t in rows:
        kept = [x for x in t.split("\n") if counts[key(x)] < least]
        yield i, len(t.split("\n")), len(t.split("\n")) - len(kept), sha("\n".join(kept))


def test_line_dedup(docs, spark):
    same(line_dedup.report(docs).collect(), brute_lines(local(docs), 10))
    same(line_dedup.report(docs, by_document=2).collect(), brute_lines(local(docs), 2))
    out = line_dedup.drop_lines(docs, chars_col="n_chars")
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("n_chars <> length(text)").count() == 0
    assert line_dedup.report(empty(spark)).collect() == [] and line_dedup.drop_lines(empty(spark)).collect() == []


# ---- simhash
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, most):
    f = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= most
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label
        label = new


def test_simhash(docs, spark):
    rows = local(docs)
    values = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(values, 4)
    least = {k: min((i for (i, _), x in zip(rows, label) if x == k and i is not None), default=None) for k in set(label.tolist())}
    same(simhash.near_duplicates(docs).collect(), [(i, f"{v:016x}", least[k]) for (i, _), v, k in zip(rows, values, label.tolist())])
    assert simhash.near_duplicates(empty(spark)).collect() == [] and simhash.deduplicate(empty(spark)).collect() == []


def test_gray_index_against_brute_force():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.zeros(3000, dtype=np.uint64)
    for _ in range(5):
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    fps = np.unique(np.concatenate([rng.choice(centres, 3000) ^ flips, centres, rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    group = rng.integers(0, 3, len(fps))
    u, v = simhash.linked(group, np.arange(len(fps)), fps[:, None], 4)
    got = np.arange(len(fps))
    got[u] = v
    for g in range(3):
        own = np.flatnonzero(group == g)
        expected = brute_components(fps[own], 4)
        assert len({*zip(expected.tolist(), got[own].tolist())}) == len(set(expected.tolist())) == len(set(got[own].tolist()))


def test_tables_grow_with_the_fingerprints(spark, monkeypatch):
    """Samples of more bits, with more tables, find near-copies as well."""
    assert simhash.tables_for(100_000, 4, 39, 32, 16) == (32, 16)
    tables, bits = simhash.tables_for(10**11, 4, 39, 32, 16)
    assert bits == 25 and 120 <= tables <= 160
    monkeypatch.setattr(simhash, "BUCKET", 1)
    rng = random.Random(16)
    texts = [["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)] for _ in range(40)]
    near = [[*w[:100], "other", *w[101:]] for w in texts]  # similarity 0.95
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts + near)], "doc_id bigint, text string")
    assert sorted(i for i, _ in local(simhash.deduplicate(rows, sample=4))) == list(range(40))


def test_hot_buckets_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_LEAST", 16)
    monkeypatch.setattr(simhash, "HOT_TIMES", 0)
    rng = np.random.default_rng(6)
    base = 0x0123456789ABCDEF
    values = list({base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(200)})
    nodes = spark.createDataFrame([(i, int(v).to_bytes(8, "big")) for i, v in enumerate(values)], "node bigint, fp binary")
    roots = {r["node"]: r["root"] for r in simhash.link_fingerprints(nodes, 1, 4, simhash.exact_masks(5, 4), len(values)).collect()}
    label = brute_components(values, 4)
    got = [roots.get(i, i) for i in range(len(values))]
    assert got == label.tolist()


def test_simhash_deduplicate(docs, spark):
    out = simhash.deduplicate(docs)
    left = [t for _, t in local(out)]
    assert out.columns == docs.columns
    copy = " ".join(f"w{i}" for i in range(120))
    assert sum(t.lower().replace("zz", "w60") == copy for t in left) == 1
    once = {t for _, t in local(docs) if len(t.split()) > 20 and t.lower().replace("zz", "w60") != copy}
    assert once <= set(left)
    assert len([t for t in left if t == local(docs)[3][1]]) == 1


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = graph.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: root(x) for x in parent if root(x) != x}


# ---- decontamination
def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        b = words(t)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {str(i)} if i is not None else {""}
    found.discard("")
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


@pytest.mark.parametrize("bound", [64 << 20, 0])
@pytest.mark.parametrize("short", [False, True])
def test_decontaminate(docs, spark, bound, short, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
    copy = [f"W{i}" for i in range(120)]
    items = [(1, " ".join(copy[40:55])), (10, " ".join(copy[100:]) + " more words that follow"), (2, None), (3, "!!"), (None, " ".join(copy[:12])), (4, "tHe " * 12), (1, " ".join(copy[40:55]))]
    items += [(5, "Own 3"), (6, "null-id. TEXT here")] if short else []
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.report(docs, bench)
    same(found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), [(i, *brute_hits(t, items)) for i, t in local(docs)])
    if bound:
        kept = decontaminate.remove(docs, bench)
        assert kept.columns == docs.columns and kept.count() == found.where("not contaminated").count()
        none = spark.createDataFrame([], "item_id bigint, text string")
        assert decontaminate.report(docs, none).where("n_hit > 0").count() == 0 and decontaminate.report(empty(spark), bench).collect() == []


# ---- passages
def test_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    own = lambda n: [word() for _ in range(n)]
    shared, near = own(60), own(80)
    changed = [*near]
    changed[40] = "other"
    rows = [(1, own(70) + shared + own(30)), (2, shared + own(90)), (3, own(200)), (4, own(20) + near), (5, changed + own(10)), (6, own(30) + shared[:30] + own(60)), (7, own(30) + shared[:30] + own(60))]
    table = [(i, " ".join(w)) for i, w in rows] + [(8, None), (9, ""), (None, " ".join(own(20) + shared)), (3, " ".join(rows[2][1]))]
    docs = spark.createDataFrame([(*r, "x") for r in table], "doc_id bigint, text string, uid string")
    found = passages.classes(docs).collect()
    same([(r["doc_id"], r["class_id"], r["n_links"] > 0) for r in found], [(1, 1, True), (2, 1, True), (3, 3, True), (3, 3, True), (4, 4, True), (5, 4, True), (6, 6, False), (7, 7, False), (8, 8, False), (9, 9, False), (None, 1, True)])
    spans = {r["doc_id"]: r["passages"] for r in found}
    assert spans[2][0]["start"] == 0 and 60 <= spans[2][0]["stop"] <= 66
    assert passages.classes(docs.limit(0)).collect() == []


def made_texts(n: int, seed: int) -> list[list[str]]:
    rng = random.Random(seed)
    return [["".join(rng.choices("abcdefghij", k=6)) for _ in range(120)] for _ in range(n)]


def as_docs(spark, table):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(table)], "doc_id bigint, text string")


def test_passages_among_unrelated_holders(spark):
    """Two texts share a passage all of whose shingles stand in unrelated texts too, which are both ends of every signature."""
    table = made_texts(400, 21)
    passage = table[0][20:72]
    table[1][40:92] = passage
    for k, text in enumerate(table[2:]):  # twenty words of the passage each
        at = k % 33
        text[50:70] = passage[at : at + 20]
    docs = as_docs(spark, table)
    for parameters in ({}, {"split": 40}, {"split": 40, "hot": 30}):  # whole, beside each part, and dealt into pairs of parts
        found = {r["doc_id"]: r for r in passages.classes(docs, **parameters).collect()}
        assert found[1]["class_id"] == 0 and found[0]["n_links"] == found[1]["n_links"] == 1
        (start, stop), = found[1]["passages"]
        assert 35 <= start <= 40 and 92 <= stop <= 97  # a tenth of the shingles may differ
        assert all(found[i]["class_id"] == i and not found[i]["n_links"] for i in range(2, 400))


def test_many_holders_meet_in_parts(spark):
    """Families of edited copies whose signatures have many holders give the same classes whole and in parts."""
    rng = random.Random(35)
    families, table = made_texts(3, 36), []
    for k in range(240):
        text = list(families[k % 3])
        for at in rng.sample(range(120), rng.choice((1, 2, 6))):
            text[at] = f"edit{k}x{at}"
        text[40:60] = families[0][40:60]  # a phrase of all
        table.append(text)
    docs = as_docs(spark, table)
    whole = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in passages.classes(docs).collect()}
    assert {c for c, n in whole.values() if n} == {0, 1, 2}
    for parameters in ({"split": 8}, {"split": 8, "hot": 10}):
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in passages.classes(docs, **parameters).collect()} == whole


def test_recall_of_edited_passages(spark):
    """Lone pairs of passages with one word changed, added or left out (similarity 0.8 to 0.9), against brute force."""
    table = made_texts(2400, 33)
    rng = random.Random(34)
    width, expected = 46, []
    for i in range(0, len(table), 2):
        n = rng.randint(50, 56)
        passage, at = table[i][30 : 30 + n], rng.randint(4, n - 5)
        edited = [passage[:at] + ["changed"] + passage[at + 1 :], passage[:at] + ["added"] + passage[at:], passage[:at] + passage[at + 1 :]][i // 2 % 3]
        table[i + 1][10 : 10 + len(edited)] = edited
        a, b = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (table[i], table[i + 1]))
        windows = [[set(x[k : k + width]) for k in range(len(x) - width + 1) if len(set(x[k : k + width]) & set(y)) >= 41] for x, y in ((a, b), (b, a))]
        if any(len(x & y) >= 0.8 * len(x | y) for x in windows[0] for y in windows[1]):
            expected.append(i)
    found = {r["doc_id"]: r["class_id"] for r in passages.classes(as_docs(spark, table)).collect()}
    caught = [i for i in expected if found[i + 1] == i]
    print(len(expected), len(caught))
    assert len(expected) > 500 and len(caught) >= 0.995 * len(expected)


@pytest.mark.parametrize("few, many", [(24, 256), (3, 256), (3, 1)])
def test_passage_groups_against_brute_force(few, many, monkeypatch):
    """Groups of one signature, few and many, with chains of edited copies, against all pairs; the last by second hashes."""
    monkeypatch.setattr(passages, "FEW", few)
    monkeypatch.setattr(passages, "MANY", many)
    rng = np.random.default_rng(5)
    width, needed = 46, 41
    for n, families in ((10, 3), (80, 6), (300, 60)):
        base = rng.integers(1, 1 << 16, (families, 91)).astype("<u2")
        base[:, 35:56] = base[0, 35:56]  # a common phrase
        rows = base[rng.integers(0, families, n)]
        for r in rows:
            at = rng.integers(0, 86, rng.integers(0, 4))
            for a in at:
                r[a : a + 5] = rng.integers(1, 1 << 16, 5)
            if rng.random() < 0.2:
                r[46:] = np.roll(r[46:], 2)
            if rng.random() < 0.2:
                r[:20] = 0
        rows[:, 45] = 7
        i, j = (x.ravel() for x in np.triu_indices(n, 1))
        good, _ = passages.verified(rows[i], rows[j], width, needed)
        a, b = i[good], j[good]
        root = list(range(n))
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root[x], root[y]
            root = [min(x, y) if r in (x, y) else r for r in root]
        if families == 6:  # and runs of one shingle
            rows[: n // 2, 20:60] = 7
            rows[: n // 4, 5:20] = rows[: n // 4, 4:5]
            good, _ = passages.verified(rows[i], rows[j], width, needed)
            a, b = i[good], j[good]
            root = list(range(n))
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = root[x], root[y]
                root = [min(x, y) if r in (x, y) else r for r in root]
        label, low, high = passages.grouped(np.zeros(n, dtype=np.int64), rows, width, needed)
        assert label.tolist() == root and ((high >= 0) == np.isin(np.arange(n), np.concatenate([a, b]))).all()


@pytest.mark.parametrize("looked_up", [8_000_000, 64])
def test_large_groups_lose_no_pair(looked_up, monkeypatch):
    """Pairs with five changed shingles among many holders of a signature; one of them shares no second least hash."""
    monkeypatch.setattr(passages, "LOOKED_UP", looked_up, raising=False)
    rng = np.random.default_rng(8)
    width, needed, n = 46, 41, 250
    rows = rng.integers(2, 1 << 24, (2 * n, 2 * width - 1)).astype(np.uint32)
    rows[:, width - 1] = 1
    for k, start in enumerate(rng.integers(0, width, n)):
        rows[2 * k + 1, start : start + width] = rows[2 * k, start : start + width]
        at = np.setdiff1d(np.arange(start, start + width), [width - 1])
        rows[2 * k + 1, rng.choice(at, width - needed, replace=False)] = rng.integers(2, 1 << 24, width - needed)
    assert len(rows) > passages.MANY
    label, _, _ = passages.grouped(np.zeros(2 * n, dtype=np.int64), rows, width, needed)
    assert label.tolist() == [i // 2 * 2 for i in range(2 * n)]


def test_passages_of_equal_contexts_over_any_batches():
    """The pass over ordered windows gives the same whatever the batches are, and what plain groups give."""
    rng = random.Random(10)
    for _ in range(40):
        rows = sorted({(rng.randrange(3), rng.randrange(3), rng.randrange(4), rng.randrange(3)) for _ in range(rng.randint(1, 40))})
        expected, windows = set(), []
        for key, context in {r[:2] for r in rows}:
            own = [r for r in rows if r[:2] == (key, context)]
            if len({r[2] for r in own}) > 1:
                first = own[0][2]
                expected |= {(passages.LINK, u, u, at, own[-1][2] if u == first else first) for *_, u, at in own}
            if len({r[1] for r in rows if r[0] == key}) > 1:
                windows.append((passages.WINDOW, key, *own[0][2:], own[0][2]))
        for size in (1, 2, 5, 100):

            class Frame:
                def mapInArrow(self, run, schema):
                    batches = (passages._first_pass(passages.WINDOW, *(np.array(c, dtype=np.int32 if k == 3 else np.int64) for k, c in enumerate(zip(*rows[i : i + size]))), np.zeros(len(rows[i : i + size]), dtype=np.int64)) for i in range(0, len(rows), size))
                    return [tuple(r.values()) for b in run(batches) for r in b.to_pylist()]

            found = passages._met(Frame())
            same([r for r in found if r[0] == passages.WINDOW], windows)
            assert {r[:4] for r in found if r[0] == passages.LINK} == {r[:4] for r in expected}


def test_compact_windows_against_all_passages():
    rng = np.random.default_rng(9)
    for _ in range(20):
        y = rng.integers(1, 50, 40).astype(np.uint64)
        y[rng.integers(0, 40, 2)] = 0
        windows = list(zip(*map(lambda a: a.tolist(), passages.compact_windows(y, 5))))
        for i in range(40):
            for j in range(i + 4, 40):
                if (y[i : j + 1] == 0).any():
                    continue
                holding = [c for left, c, r in windows if left <= i <= c <= j <= r]
                assert holding == [i + int(y[i : j + 1].argmin())]


# ---- secrets
def test_secrets(docs, spark):
    key = "q7Zp9Xw2Lk4Vb8Rt1Ny6Mc3Hd5"
    extra = [f"pässword note: Password = '{key}' end", f"AKIA{'A1' * 8} é deadbeef0123456789", f"see {key} here", "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "token=token=abcdefghijkl", "ſecret=abcdefghijklmnop", "api-key: abcdefghijklmnop"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").union(more)
    a = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    expected = []
    for i, t in local(rows):
        spans = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        kinds = [k for _, k, _ in spans]
        expected.append((i, kinds.count(0), kinds.count(1), kinds.count(2), sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)))))
    found = secrets.scan(rows)
    same(found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect(), expected)
    tokens = {r["doc_id"] for r in found.where("n_token > 0").collect()}
    assert 1002 in tokens and not tokens & {1003, 1004}
    assert secrets.scan(empty(spark)).collect() == []


def test_random_strings_are_found_and_names_are_not(spark):
    """Recall of random strings by alphabet, and no span in names, paths, words, digests and identifiers."""
    rng = random.Random(12)
    alphabets = {"lower": "abcdefghijklmnopqrstuvwxyz", "letters": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"}
    rows = [(kind, f"see {''.join(rng.choices(a, k=rng.choice((20, 24, 32, 40))))} here") for kind, a in alphabets.items() for _ in range(300)]
    names = "getUserAccountSettings HttpServletRequestWrapper src/main/java/com/example/App internationalization electroencephalographically some-long-kebab-case-name SOME_LONG_CONSTANT_NAME Donaudampfschifffahrtsgesellschaft AbstractSingletonProxyFactoryBean unconstitutionally-minded /usr/local/share/doc/python 2024-01-01T00-00-00-00-00 550e8400-e29b-41d4-a716-446655440000 D41D8CD98F00B204E9800998ECF8427E sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU= 12345678901234567890123 =========================".split()
    rows += [("name", f"see {x} here") for x in names]
    found = secrets.scan(spark.createDataFrame(rows, "kind string, text string"), id_col="kind").groupBy("kind").agg(F.avg((F.col("n_token") > 0).cast("int")).alias("share")).collect()
    share = {r["kind"]: r["share"] for r in found}
    print(share)
    assert share.pop("name") == 0 and share.pop("lower") >= 0.85 and min(share.values()) >= 0.97


def test_parts_of_runs_beside_patterns():
    rng = random.Random(13)
    run = "".join(rng.choices("ghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=30))
    text = f"{run}0123456789abcdef0123{run} {run}".encode()
    base = secrets.base_spans(text)
    assert base == [(30, 2, 50)]
    assert secrets.random_spans(text, base, secrets.loaded(secrets.DEFAULT_VOCABULARY)) == [(0, 3, 30), (50, 3, 80), (81, 3, 111)]
    for _ in range(300):  # against sets of places
        cuts = sorted(rng.sample(range(60), 8))
        marks = re.finditer("x+", "".join(rng.choices("xx.", k=60)))
        runs = list(marks)
        covers = [(a, 0, b) for a, b in zip(cuts[::2], cuts[1::2])] + [(cuts[0], 1, cuts[3])]
        places = {p for m in runs for p in range(*m.span())} - {p for a, _, b in covers for p in range(a, b)}
        assert sorted(p for a, b in secrets.uncovered(runs, covers) for p in range(a, b)) == sorted(places)


def test_long_texts_of_secrets_take_linear_time(spark):
    import time

    key, encoding = "q7Zp9Xw2Lk4Vb8Rt1Ny6Mc3Hd5", secrets.loaded(secrets.DEFAULT_VOCABULARY)

    def seconds(n):
        text = (f"password = {key} {key}! 0123456789abcdef " * n + "é").encode()
        began = time.process_time()
        base = secrets.base_spans(text)
        every = secrets._named(text, base + secrets.random_spans(text, base, encoding))
        assert len(every) == 3 * n
        return time.process_time() - began

    seconds(1000)
    assert seconds(80_000) < 8 * max(0.05, seconds(20_000)) and secrets.scan(spark.createDataFrame([(1, "a" * 2_000_000)], "doc_id bigint, text string")).first()["n_token"] == 0


# ---- chat
def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", r"\### assistant: </turn> \b \\h é"), (1, None, None, None), (2, 0, "assi:stant", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 1, "assistant", "###</turn>\n"), (3, 0, "user", "y" * 5000)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.format_turns(chat.canonical_turns(turns))
    expected = []
    for conv in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for *_, role, t in own if role == "assistant")
        expected.append((conv, len(own), sha("".join(f"{role}\n{t}\n" for *_, role, t in own)), len(loss), sha(loss)))
    same(chat.digests(made).drop("formatted_chars").collect(), expected)
    assert chat.digests(chat.format_turns(chat.canonical_turns(turns.limit(0)))).collect() == []


def test_chat_layouts(spark):
    listed = spark.createDataFrame([(1, [("human", "a"), ("gpt", None)])], "conv_id bigint, conversations array<struct<`from`: string, value: string>>")
    same(chat.canonical_turns(listed).collect(), [(1, 0, "user", "a"), (1, 1, "assistant", "")])
    asked = spark.createDataFrame([(1, "do", "", "done"), (2, "do", "it", "done")], "conv_id bigint, instruction string, input string, output string")
    same(chat.canonical_turns(asked).collect(), [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "do"), (2, 1, "user", "it"), (2, 2, "assistant", "done")])
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id bigint, story string"))
    json = ['{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "more": 1}', '{"prompt": "p", "completion": "c"}', "{bad", None, '{"story": 1}']
    json += ['{"messages": [{"content": "s"}, {"role": "assistant", "content": "b"}]}', '{"messages": [{"role": "user", "content": "a"}], "prompt": "p", "completion": "c", "response": "r"}', '{"prompt": "p", "completion": "c", "answer": 1}']
    mixed = spark.createDataFrame([(i, j) for i, j in enumerate(json)], "conv_id bigint, record string")
    more = chat.canonical_turns_of_json(mixed.where("conv_id > 4"), "record").collect()
    same(more, [(5, 0, "", "s"), (5, 1, "assistant", "b"), (6, 0, "user", "a"), (7, 0, "user", "p"), (7, 1, "assistant", "c")])
    wide = spark.createDataFrame([(1, "p", "c", "a")], "conv_id bigint, prompt string, completion string, answer string")
    same(chat.canonical_turns(wide).collect(), [(1, 0, "user", "p"), (1, 1, "assistant", "c")])
    mixed = mixed.where("conv_id <= 4")
    same(chat.canonical_turns_of_json(mixed, "record").collect(), [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "p"), (1, 1, "assistant", "c")])


# ---- warc
def test_warc(spark):
    big, other = "<p>é</p>" * 40, "z" * 100
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (9, "u", other), (9, "u", other), (8, "u", "w" * 60_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, first int")

    def expected():
        seen = {}
        for i, _, h in sorted(rows, key=lambda r: r[0]):
            b = (h or "").encode()
            first = seen.setdefault(b, i) if len(b) >= 100 else None
            again = first is not None and (first != i or (i, b) in done)
            done.add((i, b))
            yield i, len(b), sha(b), "revisit" if again else "response", first if again else None

    contents = []
    for _ in range(2):
        folder = fresh_path(spark, "test-warc")
        manifest = warc.write(pages, folder, shard_bytes=1500, roll_bytes=400)
        contents.append(sorted(map(tuple, manifest.collect())))
        done = set()
        found = warc.read_folder(spark, folder)
        same(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), expected())
        assert {bytes(r["payload"]).decode() for r in found.where("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert contents[0] == contents[1] and len(contents[0]) > 3
    folder = fresh_path(spark, "test-warc")
    assert warc.read(warc.write(pages.limit(0), folder), folder).collect() == []


def test_few_row_groups_are_spread(spark, tmp_path):
    from lamella.llm._common import spread

    rows = spark.range(1000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    rows.repartition(8).write.parquet(str(tmp_path / "many"))
    parts = lambda df: df.select(F.spark_partition_id()).distinct().count()
    one, many = (spark.read.parquet(str(tmp_path / k)) for k in ("one", "many"))
    assert parts(one) == 1 and parts(spread(one)) > 1 and sorted(map(tuple, spread(one).collect())) == sorted(map(tuple, rows.collect()))
    shuffled, few = one.repartition(3), one.limit(5)
    assert all(spread(df) is df for df in (many, shuffled, few, spark.range(10)))


def test_names_that_clash(spark):
    """Tables whose other columns have the names that the operators use inside."""
    pages = spark.createDataFrame([(i, "u", "z" * 200, "x", 1, 1, None, "d") for i in (3, 1, 2)], "page_id bigint, url string, html string, digest string, kind int, shard int, `first` string, payload string")
    folder = fresh_path(spark, "test-warc")
    found = warc.read(warc.write(pages, folder), folder)
    same(found.select("page_id", "record_type", "refers_to").collect(), [(1, "response", None), (2, "revisit", 1), (3, "revisit", 1)])
    text = "when people read books they often learn about history and science from many authors of old times"
    docs = spark.createDataFrame([(1, text, "en", False, -1, 0.5, "k"), (2, "x", "en", True, -1, 0.5, "k")], "doc_id bigint, text string, lang string, kept boolean, n_words int, chars_per_token double, id string")
    assert [tuple(r) for r in quality.keep(docs).collect()] == [(1, text, "en", False, -1, 0.5, "k")]
    copies = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(80)), 1, 2, "u", "k", 3) for i in ("b", "a", "a")] + [("c", "other", 1, 2, "u", "k", 3)], "doc_id string, text string, uid int, `key` int, `id` string, words string, root int")
    same([(r["doc_id"], r["class_id"], r["n_links"]) for r in passages.classes(copies).collect()], [("a", "a", 2), ("a", "a", 2), ("b", "a", 2), ("c", "c", 0)])
    odd = spark.createDataFrame([(1, "same words here and there", 5, 6, "f"), (2, "same words here and there", 5, 6, "f")], "doc_id bigint, text string, root int, fp int, lm_row string")
    out = simhash.deduplicate(odd)
    assert out.columns == odd.columns and [tuple(r) for r in out.collect()] == [(1, "same words here and there", 5, 6, "f")]


# ---- pipeline
def test_pipeline_stages_keep_their_contracts(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = local(docs)
        docs = stage(spark, docs, sf_dir).cache()
        after = local(docs)
        assert docs.columns == columns and {i for i, _ in after} <= {i for i, _ in before}
        if name == "line_dedup":
            same([(i, sha(t)) for i, t in after], [(i, h) for i, _, _, h in brute_lines(before, 10)])
        if name == "decontaminate":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            assert {i for i, _ in after} == {i for i, t in before if not brute_hits(t, items)[-1]}
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    same(bpe.decode(encoded).collect(), local(docs))


def brute_wide(text):
    """The 256-bit fingerprint of the distinct five-word shingles, as four numbers."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = np.array(sorted({xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[k : k + 5] for k in range(len(w) - 4)] or ([w] if w else []))}), dtype=np.uint64)
    return [sum(1 << b for b in range(64) if 2 * int((simhash._mixed(h, k) >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for k in range(4)]


def brute_deduplicated(rows):
    """Of (id, text, ...) rows those that stay: all pairs of fingerprints are compared, and the least id of a component stays, once."""
    f = np.array([brute_wide(r[1] or "") for r in rows], dtype=np.uint64).reshape(-1, 4)
    near = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2) <= 39
    label = np.arange(len(rows))
    while (new := np.array([label[near[i]].min() for i in range(len(rows))])).tolist() != label.tolist():
        label = new
    out = {}
    for k, r in zip(label.tolist(), rows):
        best = out.get(k)
        if best is None or (r[0] is None, r[0] or 0) < (best[0] is None, best[0] or 0):
            out[k] = r
    return list(out.values())


def brute_pipeline(rows, items):
    """(id, ids of the text that is left) of (id, text, lang) rows, by plain loops over all of them."""
    import sentencepiece
    from tokenizers import Tokenizer

    model = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path(quality.DEFAULT_PIECES))
    t = Tokenizer.from_file(bpe.vocabulary_path(bpe.DEFAULT_VOCABULARY))

    def good(text, lang):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        return len(w) >= 10 and 100 * len(hit) <= 20 * len(w) and brute_fertility(text, lang, model)

    rows = [(i, x or "", lang) for i, x, lang in rows if good(x or "", lang)]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    counts = Counter(k for _, x, _ in rows for k in {key(y) for y in x.split("\n")} if k)
    rows = [(i, "\n".join(y for y in x.split("\n") if counts[key(y)] < 10), lang) for i, x, lang in rows]
    rows = [r for r in brute_deduplicated(rows) if not brute_hits(r[1], items)[-1]]
    return [(i, tuple(t.encode(x, add_special_tokens=False).ids)) for i, x, _ in rows]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids").collect()
    same([(r["doc_id"], tuple(r["ids"])) for r in found], brute_pipeline(rows, items))


def test_pipeline_stages_on_odd_rows(docs, spark, tmp_path):
    """All stages in a row over nulls, repeated rows, ids with two texts, long texts and clashing names; and over no rows."""
    import corpus_pipeline

    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    for table in (docs, empty(spark)):
        rows, now = [tuple(r) for r in table.select("doc_id", "text", "lang").collect()], table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, "/root/testdata/sf0.001")
            assert out.columns == (["doc_id", "n_tokens", "ids"] if name == "bpe" else docs.columns)
            out.write.parquet(f"{tmp_path}/{table is docs}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{table is docs}-{k}")
        same([(r["doc_id"], tuple(r["ids"])) for r in now.collect()], brute_pipeline(rows, items))


@pytest.mark.parametrize("ids", [[-(1 << 63), 0, (1 << 63) - 1, None], list(range(-50, 50)), [7, 7, None], [None]])
def test_shards_ascend_with_the_key(spark, ids):
    from lamella.llm._shards import shard_plan

    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    shard, n = shard_plan(df, "id", F.lit(1), 2)
    rows = sorted(((i is not None, i or 0), s) for i, s in df.select("id", shard.alias("s")).collect())
    got = [s for _, s in rows]
    assert got == sorted(got) and set(got) <= set(range(n))


@pytest.mark.parametrize("far", [[], [1 << 60], [-(1 << 63), (1 << 63) - 1], [(1 << 50) + 3 * i for i in range(3000)]])
def test_far_out_keys_leave_shards_even(spark, far):
    from lamella.llm._shards import shard_plan

    df = spark.range(100_000).union(spark.createDataFrame([(i,) for i in far], "id bigint")) if far else spark.range(100_000)
    shard, n = shard_plan(df, "id", F.lit(10), 10_000)
    found = df.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("shard").collect()
    assert len(found) == n and 100 <= n <= 130 and max(r["n"] for r in found) <= 1000
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))

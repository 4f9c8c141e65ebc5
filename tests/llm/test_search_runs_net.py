"""Lexical search, periodic runs and the quality network: brute force, held-out accuracy and defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from baseloom.llm import lexical_search, periodic_runs, quality_net
from baseloom.llm.registry import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    None,
    "",
    " \n\t ",
    "--- !!! ---",
    "The cat sat on the mat, the CAT sat.",
    "the cat sat on the mat; the cat sat!",
    "A dog é-Ü über x2 2x \x85 dog\x1cdog",
    "cat " * 40,
    "und " * 23,
    "ja nein " * 12 + "ja",
    "a b c " * 8 + "a b" + " tail words here",
    "x" * 60_000,
    " ".join(f"w{i % 997}" for i in range(30_000)),
    " ".join(f"rare{i}" for i in range(3_000)),
]
DIRTY = " ".join(f"wor{i}###" for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "y", "y"), (None, TEXTS[4], "en", "z", "z")]
    names = "doc_id long, text string, lang string, score string, rank string"
    more = "term string, df string, k string, label string, h string, chunks string, n_runs string, predicted string, start string"
    out = spark.createDataFrame(rows, names)
    return out.withColumns({c.split()[0]: F.lit("clash") for c in more.split(", ")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, asked in wanted.items():
        found = []
        for key, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "The CAT"), (2, "mat dog über"), (3, "nothing-of-this q"), (4, None), (5, "..."), (6, "rare7 rare8 the w5 w6 x2"), (7, "cat"), (7, "dog"), (7, "dog"), (None, "sat")]


@pytest.mark.parametrize("postings", [1 << 20, 3, 600])
def test_search(spark, docs, postings):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("score", F.lit("clash"))
    index, n, total = lexical_search.build_index(docs, postings)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert (n, total) == (sum(bool(terms(t)) for _, t in rows), sum(len(terms(t)) for _, t in rows))
    for k in (1, 3, 10):
        got = sorted((tuple(r) for r in lexical_search.search(index, n, items, k).collect()), key=str)
        assert got == ranked(rows, ITEMS, k)


def test_search_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 3)
    monkeypatch.setattr(lexical_search, "FRONTIER", 20)
    monkeypatch.setattr(lexical_search, "AT_ONCE", 1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n, _ = lexical_search.build_index(docs)
    got = sorted((tuple(r) for r in lexical_search.search(index, n, items).collect()), key=str)
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 10)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n, total = lexical_search.build_index(none)
    assert (n, total) == (0, 0)
    assert lexical_search.search(index, n, items).count() == 0
    index, n, _ = lexical_search.build_index(docs)
    assert lexical_search.search(index, n, items.where("item_id < 0")).count() == 0


def test_cells_hold_all_points():
    rng = np.random.default_rng(3)
    for bits, height in ((1, 2), (3, 8), (4, 70)):
        grid = rng.random((height, 1 << bits)) < 0.2
        grid[:, 0] |= ~grid.any(1)  # each row has a point
        rows, columns = np.nonzero(grid)
        values = rng.integers(1, 999, len(rows))
        made = lexical_search.Grid(*lexical_search.build_cells(rows, columns, values, bits), bits)
        made = lexical_search.Grid.unpack(*made.pack(), bits)
        w = np.array([3])
        for row in range(height):
            _, column, score = lexical_search.descend(made, np.array([0]), np.array([row]), w, np.ones(1, "i8"), 1 << bits)
            assert dict(zip(column, score)) == {c: 3 * v for r, c, v in zip(rows, columns, values) if r == row}


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(all(words[x] == words[x + p] for x in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_document(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    milli = 1000 * best[1] // best[2] if best else None
    return (key, len(found), *(best or (None,) * 3), milli, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, left)))


def test_runs_of_random_words():
    random.seed(5)
    total = 0
    for _ in range(300):
        some = []
        for _ in range(random.randint(1, 4)):
            n, letters = random.choice([0, 5, 23, 24, 25, 60, 150]), random.choice([1, 2, 2, 3, 20])
            w = [bytes([97 + random.randrange(letters)]) for _ in range(n)]
            for _ in range(random.randint(0, 3) if n else 0):
                q, a = random.randint(1, max(1, n // 3)), random.randrange(n)
                w = w[:a] + (w[a : a + q] * 30)[: random.randint(0, 150)] + w[a + random.randint(0, 3) :]
            some.append(w)
        for w, found in zip(some, periodic_runs.document_runs(some)):
            got = list(zip(*(x.tolist() for x in found)))
            total += len(got)
            assert got == brute_runs(w)
    assert total > 300


def test_runs_of_documents(spark, docs, none):
    # All but the 30,000 words, which are too many for brute force; ids from 0 to 400 let many ends be folded.
    some = docs.where("length(text) < 50000 or text is null")
    many = spark.createDataFrame([(i, " ".join(f"w{(i * j * j) % 13}" for j in range(i % 90))) for i in range(400)], "doc_id long, text string")
    some = some.select("doc_id", "text").unionByName(many).withColumn("runs", F.lit("clash"))
    got = sorted(map(tuple, periodic_runs.find_runs(some, fold=True).collect()), key=str)
    want = sorted((brute_document(r.doc_id, r.text) for r in some.collect()), key=str)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 15
    assert periodic_runs.find_runs(none).count() == 0
    long = periodic_runs.find_runs(docs.where("doc_id = 12"), collapsed=True).first()
    assert (long.start, long.length, long.period, long.exponent_milli) == (0, 30_000, 997, 30_090)
    assert long.text.split() == [f"w{i}" for i in range(997)] and len(long.runs) == 1


def test_runs_of_a_table(spark, data):
    rows = QUERIES["op13_periodic_runs"](spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    short = [r for r in rows if len(WORD.findall(texts[r.doc_id])) <= 300]
    assert len(short) > 50
    for r in short:
        assert tuple(r) == brute_document(r.doc_id, texts[r.doc_id])


def test_network_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op12_quality_net"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    tested = [(label[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in label]
    good, bad = (np.array([s for y, s in tested if y == v]) for v in (1, 0))
    assert np.mean(good[:, None] > bad[None]) > 0.95
    assert np.mean((good >= 0.3)) > 0.9


def test_network_cases(spark, docs, none):
    labels = [(i, i % 2, "clash") for i in range(4, 14)] + [(4, 0, "clash"), (None, 1, ""), (5, None, ""), (77, 1, "")]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    model = quality_net.learn(docs, labels)
    assert isinstance(model, dict)
    rows = quality_net.classify(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1  # null and empty alike
    assert len({r.score for r in rows if r.doc_id == 4}) == 1  # a repeated row
    assert quality_net.classify(none, model).count() == 0
    assert quality_net.learn(none, labels) == 0.5
    assert quality_net.learn(docs, labels.where("quality = 1 and doc_id > 4")) == 1.0
    assert {r.score for r in quality_net.classify(docs, 1.0).collect()} == {1.0}


def test_chunks_cover_the_text():
    for size in (0, 1, 511, 512, 513, 960, 961, 5000):
        starts = quality_net.starts_of(size)
        assert starts[0] == 0 and (size <= 512 or starts[-1] + 512 == size)
        assert (np.diff(starts) <= quality_net.STEP).all()
    text = bytes(random.Random(1).randrange(256) for _ in range(3000))
    assert quality_net.chunks_of(text, 3).shape == (3, 512)
    net = quality_net.initial()
    whole = quality_net.scores(net, [text * 800])  # in parts
    chunks = quality_net.chunks_of(text * 800)
    best, _ = quality_net.filtered(net, chunks)
    once, _ = quality_net.combined(net, quality_net.pooled(best, np.array([0]), np.array([len(chunks)])))
    assert abs(whole[0] - once[0]) < 1e-4


def test_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype("f8") for k, v in quality_net.initial().items()}
    net["filter_bias"] += 0.05
    chunks, sizes = rng.integers(0, 257, (5, quality_net.CHUNK)), np.array([2, 3])
    given = np.array([0, 2]), sizes, np.array([1, 0]), np.array([1.0, 2.0])
    _, grad = quality_net._gradients(net, chunks, *given)
    for name in ("vector", "filter", "filter_bias", "hidden", "out"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        losses = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in net.items()}
            moved[name][at] += step
            losses.append(quality_net._gradients(moved, chunks, *given)[0])
        assert abs((losses[0] - losses[1]) / 2e-5 - grad[name][at]) < 1e-2 * abs(grad[name][at]) + 1e-5


def test_one_bad_chunk_is_seen(spark):
    """Documents of many clean chunks with one dirty chunk are told from clean ones."""
    rng = random.Random(2)

    def prose(n):
        return " ".join("".join(rng.choice(["ba", "ri", "mo", "te"]) for _ in range(3)) for _ in range(n))

    rows = [(i, prose(300) + (DIRTY + " " + prose(100) if i % 2 else prose(130))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(100)], "doc_id long, quality int")
    found = quality_net.classify(docs, quality_net.learn(docs, labels)).where("doc_id >= 100").collect()
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in found]) > 0.95

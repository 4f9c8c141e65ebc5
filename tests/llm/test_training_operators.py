import hashlib
"""Edge cases and brute-force twins of the training-data operators."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baseloom.llm import html_text, jaccard_join, licenses, line_dedup, mixing, nn_graph, packing, pii, quality_rules, token_store, tokens
from baseloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{i} runs{i % 7} over{i % 11}" for i in range(60))
EDITED = PROSE.replace("word30", "other")
TEXTS = [
    None,
    "",
    " \n\t ",
    "short one",
    PROSE,
    PROSE,
    EDITED,
    PROSE.upper(),
    "A line that is here twice, really it is.\nA line that is here twice, really it is.\nAnd an end.",
    "mail a.b@c.de and a@b.c_d@e.f.g or 1.2.3.4.5.6.7.8, 256.1.1.1, 000255.1.1.1 é😀 4041 8949 7460 8795 +1 (988) 555-2485",
    "cc by CC-BY all rights reserved. SPDX-License-Identifier: MIT OR GPL-2.0-only",
    "x" * 50_000,
    "7" * 50_000,
    "1.2.3.4 " * 3_000,
    "tail <|endoftext|> of text  two spaces",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), 1) for i, t in enumerate(TEXTS)]
    rows.append((5, TEXTS[5], "en", "s1", 0, 2))  # a repeated row
    names = "doc_id long, text string, lang string, source string, n_chars long, size int"
    return spark.createDataFrame(rows, names).withColumn("f", F.lit("clash")).withColumn("kept", F.lit("clash"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def gram_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def closed(items, similar):
    """Smallest id reachable, by brute force."""
    out = {i: i for i, _ in items}
    changed = True
    while changed:
        changed = False
        for i, a in items:
            for j, b in items:
                if similar(a, b) and out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


def test_jaccard_join(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_classes(docs).collect()}
    sets = [(i, gram_set(t)) for i, t in enumerate(TEXTS)]
    want = closed([(i, s) for i, s in sets if s], lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert got == {(i, len(s), want.get(i, i)) for i, s in sets}
    assert jaccard_join.join_classes(none).count() == 0


def test_hub_search_keeps_all_that_can_link():
    """The star search by nodes lets through just what the bound allows pair by pair."""
    rng = np.random.default_rng(5)
    hubs = np.sort(rng.integers(0, 6, 400))
    base = rng.poisson(2, (6, 16))
    own = np.maximum(base[hubs] + rng.integers(-1, 2, (400, 16)) * (rng.random((400, 1)) < 0.7) * (rng.random((400, 16)) < 0.5), 0).astype("i4")
    n, hub_n = own.sum(axis=1), base.sum(axis=1)[hubs]
    order = np.lexsort((n, hubs))
    hubs, own, n, hub_n = hubs[order], own[order], n[order], hub_n[order]
    fit = 4 * np.minimum(n, hub_n) >= 3 * np.maximum(n, hub_n)
    hubs, own, n, hub_n = hubs[fit], own[fit], n[fit], hub_n[fit]
    got = jaccard_join.hub_search(hubs, n, hub_n, own, base[hubs].astype("i4"))
    want = 7 * np.minimum(own, base[hubs]).sum(axis=1) >= 3 * (n + hub_n)
    assert got.tolist() == want.tolist()
    assert 0 < want.sum() < len(want)
    none = np.zeros(0, "i8")
    assert jaccard_join.hub_search(none, none, none, np.zeros((0, 16), "i4"), np.zeros((0, 16), "i4")).tolist() == []


def test_jaccard_hot_group(spark):
    """A family of edited copies behind one hot passage, split over many leaves."""
    rng = np.random.RandomState(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(60, rng.randint(0, 4), replace=False):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:30]) + " " + " ".join(f"u{i}w{k}" for k in range(40))) for i in range(80)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == closed([(i, gram_set(t)) for i, t in rows], lambda a, b: 100 * len(a & b) >= 75 * len(a | b))


def test_tree_bound_loses_nothing():
    rng = np.random.RandomState(1)
    sets = [set(rng.randint(0, 400, rng.randint(20, 60)).tolist()) for _ in range(40)]
    sets += [set(list(s)[: int(len(s) * 0.9)]) for s in sets]
    v = np.array([np.bincount([x % 128 for x in s], minlength=128) for s in sets]).astype("i4")
    n, every = np.array([len(s) for s in sets]), np.arange(len(sets))
    i, j = jaccard_join.tree_pairs(v, n, every, every, every)
    found = set(zip(i.tolist(), j.tolist()))
    for a in every:
        for b in every:
            if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert (a, b) in found


def test_hot_runs_pass_whole(monkeypatch):
    """A key's run over many batches loses no row; short groups keep rows that have a partner."""
    monkeypatch.setattr(jaccard_join, "LONG_RUN", 40)
    key = np.r_[np.full(101, 5), [6, 6, 7, 7]]
    n = np.r_[np.full(101, 10), [10, 10, 10, 99]]
    names = ["key", "f", "n", "room", "component"]
    whole = pa.RecordBatch.from_arrays([pa.array(c.astype("i8")) for c in (key, np.arange(105), n, n, np.arange(105))], names=names)
    out = [f for b in jaccard_join._hopeful(whole.slice(at, 10) for at in range(0, 105, 10)) for f in b.column(1).to_pylist()]
    assert out == list(range(103))


def test_line_dedup(docs, none):
    rows = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(rows) == len(TEXTS) - 0
    by_id = {k[0]: r for k, r in rows.items()}
    assert by_id[0].text is None and by_id[1].text == "" and by_id[2].text == " \n\t "
    assert by_id[8].text == "A line that is here twice, really it is.\nAnd an end." and by_id[8].n_removed == 1
    assert by_id[4].text == PROSE and by_id[6].text == "" and by_id[7].text == PROSE.upper()
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.exact("abc", "abc") == (1, 1) and line_dedup.exact("abc", "abd")[0] == 0


def test_lines_of_periodic_text(spark):
    """Leaves are paired by distinct shingles: a phrase repeated more often is a longer line of almost the same set."""
    rng = np.random.RandomState(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.randint(0, 26, n))
    text = [p * k + word(4) for p in [word(150) for _ in range(6)] for k in range(2, 12)] + ["short", "ab" * 500]
    described = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text)], names=["f", "line"])
    sizes = [n for b in line_dedup._described([described]) for n in b.column(2).to_pylist()]
    assert sizes == [line_dedup.exact(x, x)[0] for x in text]
    members = spark.createDataFrame([(1, i, n, i) for i, n in enumerate(sizes)], "key long, f long, n long, component long")
    tasks = defaultdict(set)
    for r in jaccard_join.leaf_tasks(members, leaf=3).collect():
        tasks[r.key, r.l, r.r].add(r.f)
    met = {(a, b) for fs in tasks.values() for a in fs for b in fs}
    near = 0
    for i, a in enumerate(text):
        for j in range(i + 1, len(text)):
            both, either = line_dedup.exact(a, text[j])
            if 100 * both >= 75 * either:
                near += 1
                assert (i, j) in met
    assert near > 200


def test_quality_statistics(docs, none):
    out = quality_rules.judge(docs, quality_rules.DecisionList()).collect()
    for r in out:
        w = WORD.findall(r.text or "")
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        repeat = {k for v in seen.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(repeat))
        assert want == (r.stats.n_words, r.stats.word_chars, r.stats.n_symbols, r.stats.n_dup_lines, r.stats.n_repeat_words), r.doc_id
        assert r.kept == (not r.base_failed) and r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
    assert quality_rules.judge(none, quality_rules.DecisionList()).count() == 0


def test_rules_held_out():
    rng = np.random.RandomState(0)
    x, y = rng.rand(3000), rng.rand(3000)
    bad = (x > 0.8) & (y < 0.5)
    rules = quality_rules.fit_rules({"words": x, "mark_share": y}, bad, np.arange(3000) < 2000)
    a, b = rng.rand(2000), rng.rand(2000)
    hit = np.any([r.holds({"words": a, "mark_share": b}) for r in rules.rules], axis=0)
    assert (hit == ((a > 0.8) & (b < 0.5))).mean() > 0.97


def test_quality_without_labels(docs, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.learn(docs, empty).rules == []


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def test_pii_base(docs, none):
    for r in pii.find(docs.where("doc_id != 11"), pii.Trees()).collect():
        want = []
        for k, (kind, pattern) in enumerate(PII):
            for m in re.finditer(pattern, r.text or "") if r.doc_id != 12 else ():
                digits = re.sub("[^0-9]", "", m[0])
                if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                    continue
                if kind == "card" and not (12 <= len(digits) <= 19 and pii._passes(m[0])):
                    continue
                if kind == "phone" and not 9 <= len(digits) <= 15:
                    continue
                want.append((m.start(), k, m.end()))
        assert [(x.s, x.k, x.e) for x in r.base] == sorted(want), r.doc_id
    assert pii.find(none, pii.Trees()).count() == 0


def test_pii_counts_by_kind(spark, tmp_path, monkeypatch):
    text = "a@b.co 1.2.3.4 c@d.org 4111 1111 1111 1111, +1 555 123 4567 or 5.6.7.8; e@f.net"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pii, "learn", lambda documents: pii.Trees())
    got = {r.doc_id: r for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [3, 2, 1, 1]
    assert [got[1].spans.split(",").count(x) for x in ("email:0:6", "ip:7:14")] == [1, 1]
    assert [got[2][f"n_{k}"] for k in pii.KINDS] == [0, 0, 0, 0] and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pii_learns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    many = docs.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) if data.endswith("sf0.001") else docs
    trees = pii.learn(many)
    loose = spark.createDataFrame([(1, "please call (988) 555-2485 today"), (2, "nothing at all 2019 300 version 2.0.1")], "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.added] for r in pii.find(loose, trees).collect()}
    assert got == {1: [(12, 26)], 2: []}


def test_pii_of_small_tables(spark, none):
    """Without base spans the method still learns; failed base matches are candidates; a dropped candidate bars no other."""
    trees = pii.learn(none)
    loose = spark.createDataFrame([(1, "please call (988) 555-2485 today"), (2, "nothing at all, no number")], "doc_id long, text string")
    got = {r.doc_id: [(x.s, x.e) for x in r.added] for r in pii.find(loose, trees).collect()}
    assert got == {1: [(12, 26)], 2: []}
    failed = spark.createDataFrame([("host 256.1.1.1 here",)], "text string").select(F.explode(pii.candidates(F.col("text"))).alias("c")).collect()
    assert "256.1.1.1" in {r.c.t for r in failed}


def test_pii_overlaps_are_chosen_by_score(spark, monkeypatch):
    spans = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(3).alias("k"), F.lit("x" * n).alias("t")) for s, e, n in ((0, 4, 9), (3, 7, 5), (6, 9, 2))])
    monkeypatch.setattr(pii, "candidates", lambda text: spans.cast(f"array<{pii._SPAN}>"))
    trees = pii.Trees(0.0, [("length", 2.0, 1.0, ("length", 5.0, 2.0, 3.0))], {3: 0.5})
    row = pii.find(spark.createDataFrame([(1, "abcdefghij")], "doc_id long, text string"), trees).collect()[0]
    assert [(x.s, x.e, x.p) for x in row.added] == [(0, 4, 3.0), (6, 9, 1.0)]


def test_html():
    page = "<html><body><nav><a>Menu</a></nav><div class='ad'>Buy, now.</div><article><h1>A &amp; B</h1><p>One <b>bold</b>, text.<br>More\n text<p>Open.</article><div id=comments><p>I disagree, a lot.</p></div><footer>&copy; x"
    assert html_text.main_text(page) == "A & B One bold, text. More text Open."
    assert [html_text.main_text(x) for x in (None, "", "plain", "a < b and <", "<div " + "x" * 9999)] == ["", "", "plain", "a < b and <", ""]
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


def test_html_attribute_values_are_no_names():
    for a in ("href='/the-hidden-cost'", 'title="Hidden gems"', "data-hidden=false", 'href="/p?id=share"', "data-class='ad'", "title='a class=ad b'", "hidden='until-found'"):
        assert html_text.main_text(f"<div {a}><p>One, two.</p></div>") == "One, two.", a
    for a in ("hidden", "hidden=''", "title='x'hidden", "/hidden", "CLASS=ad", "class = 'big ad'", 'style="display: none"', "title=a id=share"):
        assert html_text.main_text(f"<p>One, two, three.</p><div {a}><p>Four.</p></div>") == "One, two, three.", a


def test_html_marked_wrappers():
    article = "<article><p>One, two.</p><div class='share'>Share it.</div></article>"
    for name in ("page has-sidebar", "no-sidebar", "post with-comments", "page widget", "social"):
        assert html_text.main_text(f"<div class='{name}'>{article}</div>") == "One, two.", name
        assert html_text.main_text(f"<div class='{name}'><p>One, two.</p><p>Three.</p></div>") == "One, two. Three.", name
    thread = "<div id=comments><article><p>I disagree, at length and more than once, with all of it.</p></article></div>"
    assert html_text.main_text(article + thread) == "One, two."
    assert html_text.main_text(f"<div class='page widget'>{article}{thread}</div>") == "One, two."
    assert html_text.main_text("<article><div class='entry widget'><p>One, two.</p></div></article>") == "One, two."
    assert html_text.main_text("<div role=main class=social><p>One.</p></div><p>Two, three, four.</p>") != ""


def test_html_of_any_depth():
    deep = "<div>" * 600
    page = f"<body><nav>Menu, menu.</nav>{deep}<article><p>One, two.</p>{deep}Three.{'</div>' * 600}<p>Four.</p><nav>Not this.</nav></article>{'</div>' * 600}<p>After, it.</p>"
    assert html_text.main_text(page) == "One, two. Three. Four."
    assert html_text.main_text(f"{deep}<nav>Menu, of links.</nav><p>One, two, three, four.</p>{'</div>' * 600}") == "One, two, three, four."
    many = "".join(f"<div>t{i:05d}, u." for i in range(20_000))
    assert html_text.main_text(many) == " ".join(f"t{i:05d}, u." for i in range(20_000))


def test_html_formulas_are_text():
    page = "<article><p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> be, <label>say</label>, one.</p></article>"
    assert html_text.main_text(page) == "Let x=1 be, say, one."
    assert html_text.main_text(f"<form><label>Mail</label><input></form>{page}") == "Let x=1 be, say, one."


def test_html_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").withColumn("text", F.lit("clash"))
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == pages.count()
    assert html_text.extract(pages.where("page_id < 0")).count() == 0


def test_licenses(docs, none):
    rows = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert (rows[10].n_base, rows[10].first_word, rows[10].last_word) == (3, 0, 4)
    assert rows[10].labels == ["cc-by", "gpl-2.0-only", "mit", "reserved"] and rows[10].permission == 1.0
    assert (rows[0].n_words, rows[0].first_word, rows[0].labels, rows[0].score) == (0, None, [], 0.0)
    assert licenses.scan_documents(none).count() == 0
    assert licenses.parse("MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception-2.0) */")[0] == ["mit", "apache-2.0", "gpl-2.0", "classpath-exception-2.0", "with", "and", "or"]
    assert licenses.evaluate("MIT AND") == (["mit"], 0.0) and licenses.evaluate("(GPL-2.0 OR") [1] == 0.0
    assert licenses.evaluate("GPL-3.0 AND MIT")[1] == 0.3


def test_licence_tags_of_one_line():
    tag = "SPDX-License-Identifier:"
    two = licenses.scan(f"{tag} MIT foo {tag} GPL-2.0-only")
    assert two["labels"] == ["gpl-2.0-only", "mit"] and two["permission"] == 0.3
    bare = licenses.scan(f"/* {tag} MIT OR GPL-2.0-only */ x(); /* {tag.upper()} Apache-2.0 */{tag}ISC\r\n{tag} zlib")
    assert bare["labels"] == ["apache-2.0", "gpl-2.0-only", "isc", "mit", "zlib"] and bare["permission"] == 1.0
    assert licenses.scan(f"{tag} {tag} MIT")["labels"] == ["mit"]


def test_licence_prose_is_no_label():
    for text, names, worth in (
        ("MIT and see the file", ["mit"], 1.0), ("LicenseRef-x or later", ["licenseref-x"], 0.0), ("see LICENSE", [], 0.0), ("MIT or gpl-2.0-only.", ["gpl-2.0-only", "mit"], 1.0),
        ("MIT with thanks to all", ["mit"], 1.0), ("GPL-2.0-only with Classpath-exception-2.0 and more", ["gpl-2.0-only"], 0.5), ("MIT AND whatever", ["mit"], 0.0),
        ("(MIT or Artistic-2.0) and is shipped", ["artistic-2.0", "mit"], 1.0), ("Zlib and (Ruby or BSD-3-Clause)", ["bsd-3-clause", "ruby", "zlib"], 1.0), ("", [], 0.0),
    ):
        assert (licenses.evaluate(text)[0], round(licenses.evaluate(text)[1], 6)) == (names, worth), text
    found = licenses.scan("SPDX-License-Identifier: MIT and see the file, all rights reserved")
    assert found["labels"] == ["mit", "reserved"] and found["permission"] == 1.0


def test_licence_places_by_brute_force(spark):
    import random

    rng = random.Random(3)
    parts = ["cc", "by", "sa", "general", "public", "license", "all", "rights", "reserved", "CC-BY", "General Public\nLicense", "x", "7", "\u00e9by", "_", "", ".", "cc by cc by"]
    texts = [rng.choice([" ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "cc by " * 40_000]
    rows = licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        places = [(i, n) for p, n in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r.base_labels == sorted({n for _, n in places}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert len(rows) == len(texts)


def ids_of(text):
    return tokens.encoder()._raw([text or ""])[0].tobytes() + np.uint32(0).tobytes()


def test_packing(docs, none):
    pieces = defaultdict(list)
    rows = packing.pack(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for i, t in enumerate(TEXTS):
        own = sorted(pieces[i], key=lambda r: (r.start, r.sequence_id))
        own = own[::2] if i == 5 else own  # the repeated row
        assert b"".join(bytes(r.ids) for r in own) == ids_of(t), i
    assert packing.pack(none).count() == 0
    assert packing.lengths(2048 + 5) == [1024, 1024, 4, 1]


def test_token_store(docs, none, spark):
    path = scratch_path(spark, "test-store")
    token_store.write_store(docs, path)
    at = 0
    rows = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(TEXTS)), 5])
    for r in rows:
        data = ids_of(TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(data) // 4, data)
        at += r.n_tokens
    one = token_store.read_store(spark, path, only=[9]).collect()
    assert [(r.doc_id, bytes(r.ids)) for r in one] == [(9, ids_of(TEXTS[9]))]
    path = scratch_path(spark, "test-store")
    token_store.write_store(none, path)
    assert token_store.read_store(spark, path).count() == 0


def test_encoder_equals_whole_texts():
    rng = np.random.RandomState(5)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "ß", "22", "'s", "!", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "日", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.randint(0, 25))) for _ in range(2000)]
    small = tokens.Encoder(tokens.default_tokenizer(), cached=50)
    assert small.encode(texts, at_once=500) == [small._raw([t])[0].tobytes() if t else b"" for t in texts]


def test_mixing(docs, none, spark):
    out = mixing.mix(docs, mixing.plan(docs)).collect()
    total = sum(r.size for r in out)
    assert len(out) == len(TEXTS) + 1 and all(r.copies <= 2 for r in out)
    per = {r.source: r.target for r in out}
    assert abs(sum(per.values()) - 1.5 * total) < 1e-6
    assert all(r.target <= 2 * r.source_size for r in out)
    assert mixing.mix(none, mixing.plan(none)).count() == 0


def test_mixing_targets_are_met(spark):
    rng = np.random.RandomState(2)
    rows = [(i, "w " * int(rng.randint(1, 60)), "abc"[i % 3] if i % 10 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(docs, mixing.plan(docs)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 60


def test_nearest(spark):
    rng = np.random.RandomState(4)
    v = rng.randn(700, 8)
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(30)] + [(800, None), (801, [0.0] * 8), (802, [float("nan")] * 8), (803, [None] + [1.0] * 7), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nn_graph.nearest(table, F.col("id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(730)])
    m = np.array([rows[i][1] for i in ids])
    hit = 0
    for q in ids[::20]:
        s = m @ m[q]
        want = [i for i in np.lexsort((ids, -np.round(s, 12))) if i != q][:20]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21)) and all(abs(x[2] - s[x[1]]) < 1e-12 for x in mine)
        hit += len({x[1] for x in mine} & set(want))
    assert hit >= 0.9 * 20 * len(ids[::20]) and set(got) == set(ids[::20])
    assert nn_graph.nearest(table.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0

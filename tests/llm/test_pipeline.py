"""The pipeline, stage by stage, against brute force on a small table."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from baseloom.llm import tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, results = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.staged(stage(spark, docs, data), "test")
        assert n == 4 or docs.columns == columns
        results.append(docs)
    before, quality, lines, near, mixed = ([tuple(r) for r in x.select("doc_id", "text", "source").collect()] for x in results[:5])
    assert set(quality) <= set(before) and all(len(WORD.findall(t)) >= 10 for _, t, _ in quality)
    whole = {i: t.split("\n") for i, t, _ in quality}
    seen = set()
    for i, t, _ in sorted(lines):
        rest = iter(whole[i])
        assert all(x in rest for x in t.split("\n"))
        own = [x.strip(" \t\r\x0b\x0c") for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert own and seen.isdisjoint(own) and len(set(own)) == len(own)
        seen.update(own)
    sets = {i: grams(t) for i, t, _ in lines}
    kept = {i for i, _, _ in near}
    for i, s in sets.items():
        assert i in kept or any(j != i and 4 * len(s & u) >= 3 * len(s | u) for j, u in sets.items())
    assert not [1 for i in kept for j in kept if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    times, size = defaultdict(int), {i: len(WORD.findall(t)) for i, t, _ in near}
    for i, t, s in mixed:
        times[i] += 1
        assert (i, t, s) in set(near)
    assert max(times.values()) <= 2
    words = sum(size.values())
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * words) < 0.1 * words
    ids = defaultdict(list)
    for r in results[5].orderBy("sequence_id").collect():
        ids[r.doc_id].append((r.start, bytes(r.ids)))
    for i, t, _ in near:
        if times[i]:
            want = tokens.encoder()._raw([t])[0].tobytes() + np.uint32(0).tobytes()
            assert b"".join(x for _, x in sorted(ids[i])[:: times[i]]) == want
    assert results[5].agg(F.countDistinct("sequence_id")).first()[0] == results[5].count()


def odd_rows(spark, data):
    """Rows with null, repeated and clashing values, in the columns of documents and one more."""
    like = spark.read.parquet(f"{data}/documents.parquet").limit(1)
    body = "\n".join(" ".join(f"w{(i * 31 + j * 7) % 997}" for i in range(12)) for j in range(6))
    other = body.replace("w", "v")
    rows = [(1, body), (None, body), (1, body), (2, body + " end"), (1, other), (None, other), (None, other.upper()), (None, body[::-1]), (None, body[::-1]), (7, None), (8, ""), (9, " \n ")]
    docs = spark.createDataFrame(rows, "new_id long, new_text string").crossJoin(like)
    docs = docs.withColumn("doc_id", F.col("new_id").cast(like.schema["doc_id"].dataType)).withColumn("text", F.col("new_text"))
    return docs.select(*like.columns, F.lit("clash").alias("component_id"))


def test_one_row_of_a_group_stays(spark, data):
    docs = odd_rows(spark, data)
    kept = corpus_pipeline.near_duplicates(spark, docs, data)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), (r.text or "")[:4]) for r in kept.collect())
    body = docs.collect()[0].text
    assert got == sorted([("1", body[:4]), ("1", body.replace("w", "v")[:4]), ("None", body[::-1][:4]), ("7", ""), ("8", ""), ("9", " \n ")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), data).count() == 0

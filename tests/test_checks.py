"""Checks as rows, and the codon and mismatch kernels against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from baseloom.functions import kernels as K
from baseloom.operators import validate as V


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "a": spark.createDataFrame([(1, None, "x"), (2, None, None)], "id int, note string, name string"),
        "b": spark.createDataFrame([], "`Gene Start` int, gene_end int"),
    }


def test_header_report(spark, tables):
    rows = V.header_report(spark, tables, {"a": ["id", "name", "note", "more"], "b": ["Gene Start"], "c": ["k"]}).collect()
    got = {(r.table_name, r.column_name): (r.problem, r.n_filled) for r in rows}
    assert got == {
        ("a", "id"): ("ok", 2), ("a", "name"): ("other place", 1), ("a", "note"): ("other place", 0), ("a", "more"): ("missing", None),
        ("b", "Gene Start"): ("empty", 0), ("b", "gene_end"): ("extra", 0), ("c", "k"): ("missing table", None),
    }
    assert V.header_report(spark, {}, {}).count() == 0


def test_missing_parts(spark, tables):
    rows = V.missing_parts(spark, tables, {"a": ["id", "more"], "b": ["Gene Start"], "c": ["k", "l"]}).collect()
    assert sorted(r.message for r in rows) == ["a: column more is missing", "b: column Gene Start is empty", "no table c"]


def test_column_report(spark, tables):
    rows = V.column_report(spark, tables, {"start": ["start", "gene_start"], "id": ["ID", "name"]}).collect()
    assert {(r.table_name, r.wanted): (r.chosen, r.n_filled) for r in rows} == {
        ("a", "start"): (None, None), ("a", "id"): ("id", 2), ("b", "start"): ("Gene Start", 0), ("b", "id"): (None, None),
    }


def test_kernels(spark, monkeypatch):
    monkeypatch.setattr(K, "SLAB_BASES", 50)
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ACGTNacgt-") for _ in range(r.choice([0, 1, 2, 3, 30, 31, 200])))) for i in range(300)]
    rows = [(i, a, r.choice([a, a[::-1], a[:-1], None, a.lower()])) for i, a in rows] + [(300, None, "A"), (301, None, None)]
    code = {a + b + c: K.STANDARD_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.repartition(3).select("i", K.translate(F.col("a")).alias("p"), K.mismatches(F.col("a"), F.col("b")).alias("m")).collect()
    found = {x.i: (x.p, x.m) for x in got}
    for i, a, b in rows:
        protein = None if a is None else "".join(code.get(a[x : x + 3].upper(), "X") for x in range(0, len(a) - 2, 3))
        differ = None if a is None or b is None or len(a) != len(b) else sum(x != y for x, y in zip(a, b))
        assert found[i] == (protein, differ)

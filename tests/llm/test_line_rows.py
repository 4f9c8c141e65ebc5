"""Line dedup end to end against brute force: repeated ids, repeated rows, very long lines."""

import random

import numpy as np
import pytest

from baseloom.llm import line_dedup as L

EDGES = " \t\r\x0b\x0c"


def prose(r, n):
    return "".join(r.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))


def brute(rows):
    """(id, text) rows: per distinct row the places that go, by exact similarity of all pairs."""
    from pyspark.sql import functions as F  # noqa: F401

    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    places = [(d, p, x.strip(EDGES)) for d in docs for p, x in enumerate(d[1].split("\n")) if x.strip(EDGES)]
    kinds = sorted({x for _, _, x in places})
    up = {x: x for x in kinds}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if 0.7 < len(a) / len(b) < 1.43:
                both, either = L.exact(a, b)
                if 100 * both >= 75 * either:
                    up[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for d, p, x in places:
        groups.setdefault(find(x), []).append((d, p))
    return docs, groups, {(d, p): x for d, p, x in places}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [prose(r, r.randint(80, 160)) for _ in range(12)]
    near = [b[:40] + "#" + b[41:] for b in base]
    out = [(i, "\n".join(r.choice([*base, *near, prose(r, 90), "", "  ", "short"]) + r.choice(["", " ", "\r"]) for _ in range(r.randint(1, 5)))) for i in range(60)]
    out += [(7, "another text under one id\n" + base[0]), out[3], out[3], out[9], (61, None), (62, ""), (None, base[1] + "\n" + base[1]), (None, None)]
    big = prose(r, 1_000_000)
    return out + [(70, big), (71, big + "x"), (72, big[:400_000] + "\n" + base[2])]


def test_rows_and_places(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = L.report(docs).collect()
    assert len(got) == len(rows)
    distinct, groups, text_at = brute(rows)
    left = {d: dict(n=0, gone=[], chars=0) for d in distinct}
    cut = L.dedup_lines(docs).collect()
    assert len(cut) == len(rows)
    # Per component exactly one place stays, and it is the first by document; rows of one id tie by their texts' hashes.
    kept = {}
    for r in cut:
        kept.setdefault((r.doc_id, r.n_lines, r.n_removed), []).append(r.text)
    by_row = {}
    for r in got:
        by_row.setdefault((r.doc_id, r.n_lines, r.n_removed, r.n_chars_kept, r.removed), 0)
        by_row[(r.doc_id, r.n_lines, r.n_removed, r.n_chars_kept, r.removed)] += 1
    first = {}
    for members in groups.values():
        key = lambda m: (m[0][0] is not None, m[0][0] or 0, m[1])
        best = min(members, key=key)
        tied = [m for m in members if key(m) == key(best)]
        if len(tied) == 1:
            first[best] = members
    for (d, p), members in first.items():
        for m in members:
            left[m[0]]["n"] += 1
            if m == (d, p):
                left[m[0]]["chars"] += len(text_at[m])
            else:
                left[m[0]]["gone"].append(m[1])
    complete = {d for d in distinct if d[0] != 7}
    for d in complete:
        v = left[d]
        want = (d[0], v["n"], len(v["gone"]), v["chars"], ",".join(map(str, sorted(v["gone"]))))
        times = sum(r == d for r in rows)
        assert by_row.get(want, 0) >= times, (want, [k for k in by_row if k[0] == d[0]])
    assert sum(r.n_removed for r in got) > 50
    for i in (61, 62):
        assert (i, 0, 0, 0, "") in by_row


def test_alike_is_exact():
    r = random.Random(4)
    a = [prose(r, r.choice([1, 5, 11, 12, 13, 50, 400])) for _ in range(300)]
    b = [r.choice([x, x[: len(x) // 2], x + x, x[:3] + "#" + x[4:], "z"]) for x in a]
    want = []
    for x, y in zip(a, b):
        both, either = L.exact(x, y)
        want.append(100 * both >= 75 * either)
    assert L.alike(a, b).tolist() == want and any(want) and not all(want)
    assert L.alike([], []).tolist() == [] and np.array_equal(L.alike(["a"], ["a"]), [True])

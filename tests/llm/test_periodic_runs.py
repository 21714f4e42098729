"""Periodic runs against brute force over all periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    """Every stretch with w[i] == w[i + q] that is long enough and has no smaller period."""
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            m = i - a + q
            if i > a and m >= max(least, times * q) and not any(w[a : a + m - p] == w[a + p : a + m] for p in range(1, q)):
                out.append((a, m, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


blocks = st.tuples(st.lists(st.integers(0, 2), max_size=6), st.integers(1, 9)).map(lambda b: b[0] * b[1])
sequences = st.lists(blocks, max_size=8).map(lambda bs: [x for b in bs for x in b])


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences, max_size=4), st.sampled_from([(2, 2), (3, 3), (4, 3), (7, 2), (10, 3), (24, 3)]))
def test_runs_equal_brute_force(texts, bounds):
    assert pr.runs([np.array(t, np.int64) for t in texts], *bounds) == [brute(t, *bounds) for t in texts]


@settings(max_examples=200, deadline=None)
@given(sequences.filter(len), st.integers(0, 200), st.integers(0, 200))
def test_extensions_are_longest(t, a, b):
    i, j = a % len(t), b % len(t)
    if i != j:
        own = pr.Suffixes(np.array([*t, -1]), 1)
        want = next(k for k in range(len(t) + 1) if max(i, j) + k == len(t) or t[i + k] != t[j + k])
        assert own.extensions(np.array([i]), np.array([j])).tolist() == [want]
        assert (own.rank[i] < own.rank[j]) == (t[i:] < t[j:])


def expected(doc, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *top, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def told(spark, sf):
    return sorted((tuple(r) for r in pr.op13(spark, sf).collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got, want = told(spark, SF), sorted((expected(r["doc_id"], r["text"]) for r in rows if len(r["text"] or "") < 20_000), key=repr)
    assert {g for g in got if g[0] in {w[0] for w in want}} == set(want) and len(got) == len(rows)
    assert sum(r[1] > 0 for r in want) > 10


def test_edge_rows(spark, folder):
    tie = " ".join(["a"] * 24 + ["x"] + ["b"] * 24)  # equal exponents: the first
    nested = " ".join((["a"] * 24 + ["b"]) * 3)  # runs inside a run
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 23), (5, "a " * 24), (6, "a\x0bb\n" * 12), (7, "a b " * 24), (8, tie), (9, nested), (None, "a " * 24), (-5, tie), (5, "a " * 24),
        (10, " ".join(["a"] * 30)), (11, "é ü " * 13 + "é"), (12, " ".join(str(i % 8) for i in range(25))),
    ]
    got = told(spark, folder(rows))
    assert got == sorted((expected(*r) for r in rows), key=repr)
    assert {r[0]: r[1] for r in got if r[0] in (4, 9, 12)} == {4: 0, 9: 4, 12: 1}
    assert pr.op13(spark, folder([])).count() == 0


def test_very_long_texts(spark, folder):
    ids = [d for d in range(100) if zlib.crc32(str(d).encode()) % 10][:3]
    cycle = " ".join(f"w{i}" for i in range(1000)) + " "
    rows = [(ids[0], "a " * 300_000), (ids[1], cycle * 200), (ids[2], " ".join(f"w{i}" for i in range(200_000)))]
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in pr.op13(spark, folder(rows)).collect()}
    assert got == {ids[0]: (1, 0, 300_000, 1, 300_000_000), ids[1]: (1, 0, 200_000, 1000, 200_000), ids[2]: (0, None, None, None, None)}


def test_collapsed_text_is_a_column(spark, folder):
    rows = pr.scan_runs(spark.read.parquet(folder([(4, "x " + "a b " * 20 + "y")]) + "/documents.parquet")).collect()
    assert [(r["collapsed"], [tuple(x) for x in r["runs"]]) for r in rows] == [("x a b y", [(1, 40, 2)])]

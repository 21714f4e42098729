"""Decontamination against windows taken one by one."""

import hashlib
import pickle
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import decontamination as dc

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(items, doc, window=10):
    """Hit places and the names of items with a window in doc; items: (name, words)."""
    places, names = set(), set()
    for name, own in items:
        n = min(len(own), window)
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for p in range(len(doc) - n + 1):
            if tuple(doc[p : p + n]) in wanted:
                places |= set(range(p, p + n))
                names.add(name)
    return places, names - {None}


letters = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=24)


@settings(max_examples=400, deadline=None)
@given(st.lists(letters, max_size=5), letters, st.lists(st.integers(0, 4), max_size=3), st.sampled_from([1, 2, 3, 5, 10]))
def test_hits_equal_windows(items, doc, put, window):
    for k in put:
        doc = doc + items[k][: 3 * window] if k < len(items) else doc
    named = [(str(i), w) for i, w in enumerate(items)]
    reader = dc.Reader(pickle.loads(pickle.dumps(dc.build(named, window))))
    spans, found = reader.hits(doc)
    places, names = brute(named, doc, window)
    assert {i for a, b in spans for i in range(a, b)} == places and {reader.names[i] for i in found} == names
    assert spans == dc.merged(spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(letters, max_size=4), letters)
def test_longest_matches(items, doc):
    reader = dc.Reader(dc.build([(None, w) for w in items]))
    inside = {tuple(w[i:j]) for w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    for i, (_, length) in enumerate(reader.stream(list(map(reader.number.get, doc)))):
        assert length == max((n for n in range(i + 2) if not n or tuple(doc[i + 1 - n : i + 1]) in inside), default=0)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_words(text):
    assert [w.decode() for w in dc.words(text.encode("utf-8", "surrogatepass"))] == split(text)


def expected(items, rows):
    own = [(None if k is None else str(k), split(t)) for k, t in items]
    out = []
    for doc, text in rows:
        w = split(text)
        places, names = brute(own, w)
        out.append((doc, len(w), len(places), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(places)))
    return sorted(out, key=repr)


def bench(folder, items, kind=None):
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], kind or pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "spans": ["x"] * len(items)}), folder + "/benchmark.parquet")
    return folder


TEN = "One two three four five six seven eight nine ten"
ITEMS = [
    (1, TEN), (2, "zero " + TEN.lower() + " eleven"), (10, "Short item here"), (3, None), (4, ""), (5, " ?! "), (10, "Short item here"), (6, "naïve Ünder 東京 b2b " + TEN), (None, "nameless item of five words"), (7, "x"),
]
ROWS = [
    (1, f"before {TEN}, after"), (2, f"{TEN.upper()}; {TEN}"), (3, "a short ITEM\nhere. short item"), (4, None), (5, ""), (6, "...?!"), (7, "naïve Ünder 東京 b2b one two three four five six seven"), (8, "a nameless item of five words goes"),
    (None, TEN), (9, "X marks x-ray"), (1, TEN), (11, "one two three four five six seven eight nine"), (12, "ünder naïve"),
]


def test_edge_rows(spark, folder):
    sf = bench(folder(ROWS), ITEMS)
    want = expected(ITEMS, ROWS)
    assert sorted((tuple(r) for r in dc.op12(spark, sf).collect()), key=repr) == want
    assert {w[0]: w[2] for w in want if w[0] in (2, 3, 8, 9)} == {2: 20, 3: 3, 8: 5, 9: 2}
    assert dc.op12(spark, bench(folder([]), ITEMS)).count() == 0
    none = dc.op12(spark, bench(folder(ROWS), [])).collect()
    assert len(none) == len(ROWS) and not any(r["contaminated"] or r["n_items"] for r in none)


def test_many_automata_give_the_same(spark, folder):
    long = (8, " ".join(f"w{i}" for i in range(400)))  # cut into pieces
    rows = [*ROWS, (20, " ".join(f"w{i}" for i in range(150, 260))), (21, " ".join(f"w{i}" for i in range(391, 410)))]
    sf = bench(folder(rows), [*ITEMS, long])
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    built = dc.automata(items, shard=64)
    assert built.count() > 3 and built.select("shard").distinct().count() == built.count()
    own = [(None if k is None else str(k), split(t)) for k, t in [*ITEMS, long]]
    want = sorted(((d, len(split(t)), sorted(brute(own, split(t))[0]), sorted(brute(own, split(t))[1])) for d, t in rows), key=repr)
    for shard in (64, dc.SHARD):
        got = dc.scan(docs, items, ["doc_id"], ["n", "hits", "named", "left"], shard=shard).collect()
        assert sorted(((r["doc_id"], r["n"], [i for s in r["hits"] for i in range(s["start"], s["end"])], r["named"]) for r in got), key=repr) == want


def test_removal(spark, folder):
    rows = [(1, f"Keep this, {TEN}! And, with many more words than before, keep all that."), (2, TEN + " only"), (3, None), (4, "x y z"), (5, "a clean text")]
    sf = bench(folder(rows), ITEMS[:3])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = dc.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["spans"]) for r in got.collect()} == {1: ("Keep this, ! And, with many more words than before, keep all that.", "x"), 3: (None, "x"), 4: ("x y z", "x"), 5: ("a clean text", "x")}


def test_very_long_texts(spark, folder):
    rows = [(1, "word " * 500_000 + TEN), (2, TEN.replace(" ", " ") + " " + "one " * 300_000), (3, "é" * 1_000_000)]
    items = [(1, TEN), (2, "one " * 2000), (3, "word " * 100_000)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in dc.op12(spark, bench(folder(rows), items)).collect()}
    assert got == {1: (500_010, 500_010, 2), 2: (300_010, 300_010, 2), 3: (1, 0, 0)}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = dc.op12(spark, SF)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({dc.ORACLE})").fetchall())
    assert any(g[5] for g in got)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    short = [r for r in rows if len(r[1] or "") < 3000]
    assert {repr(g) for g in got if g[0] in {r[0] for r in short}} == {repr(e) for e in expected(items, short)}

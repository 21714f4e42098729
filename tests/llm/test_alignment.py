"""Alignment of tokens against plain loops over bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuscle.llm import alignment as al

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def stand_ins():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTES = stand_ins()


def plain(libraries, text):
    """Ids of A and B, groups and linked occurrences; None without tokens."""
    if not text:
        return None
    t, s = libraries
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = s.encode(text)
    a_bytes = [bytes(BYTES[c] for c in t.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != b"".join(b_bytes) or b"".join(a_bytes) != (" " + text).encode():
        return None
    ends = []
    for own in (a_bytes, b_bytes):
        at, out = 0, []
        for x in own:
            at += len(x)
            out.append(at)
        ends.append(out)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for c in cuts:
        groups.append(tuple([i for i, e in zip(side, es, strict=True) if low < e <= c] for side, es in zip((a, b), ends, strict=True)))
        low = c
    owner = lambda es: [k for k, e in enumerate(es) for _ in range(e - (es[k - 1] if k else 0))]
    links = sorted(set(zip(owner(ends[0]), owner(ends[1]), strict=True)))
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def expected(libraries, rows):
    found = [(d, plain(libraries, t)) for d, t in rows]
    count = Counter(p for _, f in found if f for p in set(f[3]))
    high = {}
    for (a, _), n in count.items():
        high[a] = max(high.get(a, 0), n)
    out = []
    for d, f in found:
        if not f:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(count[p] == high[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 5), min_size=1, max_size=30))
def test_overlaps_equal_a_join(a, b):
    import numpy as np

    gap = sum(a) - sum(b)
    a, b = (a, [*b, gap]) if gap > 0 else ([*a, -gap], b) if gap < 0 else (a, b)
    spans = [[(sum(x[:i]), sum(x[: i + 1])) for i in range(len(x))] for x in (a, b)]
    first, last = al.overlaps(np.array(a), np.array(b))
    for (s, e), f, m in zip(spans[0], first.tolist(), last.tolist(), strict=True):
        assert [j for j, (x, y) in enumerate(spans[1]) if x < e and s < y] == list(range(f, m))


PIECES = ["the ", "Hello", " wörld", "  ", "\n", "\t", "東京", "▁", "<s>", "<|endoftext|>", "\0", "é", "😀", "don't", "123456", "<0x41>", " ", "ﬁ", "\r\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=12).map("".join))
def test_groups_equal_plain_loops(libraries, text):
    want, own = plain(libraries, text), al._pair(*al.default_paths())
    got = own.align(text)
    assert (got is None) == (want is None)
    if want:
        a, b, groups, links = want
        assert (got.a.tolist(), got.b.tolist()) == (a, b)
        cells = [(got.a[i:j].tolist(), got.b[x:y].tolist()) for i, j, x, y in zip([0, *got.a_ends], got.a_ends, [0, *got.b_ends], got.b_ends, strict=False)]
        assert cells == groups
        codes, times = own.pairs(got)
        assert Counter(links) == {divmod(c, own.sizes[1]): n for c, n in zip(codes.tolist(), times.tolist(), strict=True)}


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "Hello world"), (5, "Hello world"), (6, "▁ is no space"), (7, "<|endoftext|> <s> as text"), (None, "Hello wörld, 東京"), (5, "Hello world"), (8, "a\0b"), (9, "x" * 3000), (10, "\n\n\t  Hello\r\n"),
    (11, "Hello there"), (12, "ﬁne"), (13, "é é"),
]


def test_edge_rows(spark, folder, libraries):
    got = sorted((tuple(r) for r in al.op11(spark, folder(ROWS)).collect()), key=repr)
    assert got == expected(libraries, ROWS)
    assert al.op11(spark, folder([])).count() == 0
    assert al.op11(spark, folder([(1, None)])).collect()[0]["n_a"] == 0


def test_query_equals_plain_loops(spark, libraries):
    """The query, and with fewer pairs in the broadcast, or none."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    want, docs = expected(libraries, rows), spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted((tuple(r) for r in al.op11(spark, SF).collect()), key=repr) == want
    facts = al._base.written(al.linked(docs, al.default_paths()).withColumn("row", al.F.monotonically_increasing_id()), f"{al._base.scratch(spark)}/facts")
    counts = al._base.written(al.pair_counts(facts, al._pair(*al.default_paths()).sizes[1]), f"{al._base.scratch(spark)}/counts")
    for hot in (0, 500):
        got = al.with_counts(facts, counts, hot).select("doc_id", *al.NUMBERS, "n_best", "count_sum", "groups_sha256")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_ids_and_groups_are_columns(spark, folder, libraries):
    row = al.align(spark.read.parquet(folder([(1, "Hello wörld, 東京")]) + "/documents.parquet")).first()
    a, b, groups, _ = plain(libraries, "Hello wörld, 東京")
    assert (row["a_ids"], row["b_ids"]) == (a, b) and len(row["groups"]) == len(groups)


def test_very_long_texts(spark, folder):
    rows = [(1, "many words " * 60_000), (2, "x" * 200_000)]
    got = {r["doc_id"]: r for r in al.op11(spark, folder(rows)).collect()}
    assert got[1]["n_a"] == 120_001 and got[2]["n_a"] > 0 and got[2]["n_groups"] > 0

"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import near_dedup as nd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=4):
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {(doc, len(sets[i]), least[find(i)], least[find(i)] == doc) for i, (doc, _) in enumerate(rows)}


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_query_equals_brute_force(spark, folder):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(120)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one two three", "One two  three\n", "\xa0 a", "É b c d e", "é b c d e"]
    texts += near_copies(rng, words(150), 70, 9)  # a large group, some of it linked only through others
    texts += [" ".join(passage + words(rng.randint(25, 60))) for _ in range(70)]  # a passage that many share
    for _ in range(30):
        texts += near_copies(rng, words(rng.randint(4, 200)), rng.randint(1, 4), 4)
    texts += [" ".join(words(20_000))] * 2
    texts += texts[20:30]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))
    got = {tuple(r) for r in nd.op2(spark, folder(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize(("small", "share", "heavy"), [(1, 2, 8), (10**6, 512, 1000)])
def test_buckets_of_any_size_follow_one_rule(spark, folder, monkeypatch, small, share, heavy):
    """All buckets taken as large ones, with shared elements split and broadcast, or all as small ones: the same components."""
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "SHARE", share)
    monkeypatch.setattr(nd._base, "HEAVY", heavy)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(80)
    texts = [*near_copies(rng, words(120), 25, 12), *(" ".join(passage + words(rng.randint(10, 60))) for _ in range(25))]
    for _ in range(12):
        texts += near_copies(rng, words(rng.randint(4, 90)), rng.randint(1, 4), 5)
    rows = list(enumerate(texts))
    assert {tuple(r) for r in nd.op2(spark, folder(rows)).collect()} == brute(rows)


def test_repeated_rows_and_empty_table(spark, folder):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (7, "a b c d e")]
    assert sorted(map(tuple, nd.op2(spark, folder(rows)).collect())) == [(3, 2, 3, True), (3, 2, 3, True), (7, 2, 3, False)]
    assert nd.op2(spark, folder([])).count() == 0


def test_words_that_fool_a_polynomial(spark, folder):
    """Thue-Morse words and their complements have one value under any polynomial modulo 2**64."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(1 << 11))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{a} x y z"), (4, f"{b} x y z")]
    assert {tuple(r) for r in nd.op2(spark, folder(rows)).collect()} == {(i, 1, i, True) for i, _ in rows}


def test_long_texts_are_cut_between_words():
    text = "word " * 3 + "x" * (nd.STEP + 5) + " " + "end " * (nd.STEP // 3)
    assert len(nd.word_hashes(text)) == len(text.split())
    assert np.array_equal(nd.word_hashes(text), np.concatenate([nd.word_hashes(w) for w in text.split()[:5]] + [nd.word_hashes("end")] * (len(text.split()) - 5)))


def test_null_and_repeated_doc_ids(spark, folder):
    t, u = "a b c d e f g", "h i j k l m n"
    rows = [(3, t), (1, t), (3, u), (None, u), (None, "lone words of another")]
    got = {tuple(r) for r in nd.op2(spark, folder(rows)).collect()}
    assert got == {(3, 4, 1, False), (1, 4, 1, True), (3, 4, 3, True), (None, 4, 3, False), (None, 1, None, True)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbÉ \n\x0b\x1c\xa0", max_size=40), max_size=8))
def test_sets_have_as_many_shingles(texts):
    got = nd.shingle_sets(texts)
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (shingles(a) == shingles(b)) == np.array_equal(got[i], got[j])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, nd.MOST), st.randoms(use_true_random=False))
def test_pigeonhole(errors, rng):
    a = np.array([rng.randrange(1 << 16) for _ in range(nd.SYMBOLS)], "<u2")
    b = a.copy()
    for i in rng.sample(range(nd.SYMBOLS), errors):
        b[i] ^= 1 + rng.randrange((1 << 16) - 1)
    x, y = nd.keys_of(a[None]), nd.keys_of(b[None])
    assert set(x.ravel()) & set(y.ravel())

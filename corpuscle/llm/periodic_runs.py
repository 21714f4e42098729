"""Periodic runs of words by the runs theorem.

A run is a stretch of words with smallest period q that no neighbouring word extends. By the runs theorem each run has a Lyndon
word as its root, which is the longest Lyndon word from where it starts, under the order of words or under the opposite order. So
all runs come from two candidates a word: from word i to the next smaller, and to the next greater, value of the inverse suffix
array. A candidate is extended to either side by the longest common extension of its two ends, a range minimum (sparse table)
over the LCP array of the text, and of the reversed text; it is a run where both extensions and the root are long enough.

Texts are put behind one another, about 4 MB at a time, with the text's number above every rank, so that suffixes of different
texts never tie, and the arrays are made for all texts of a step at once. Ranks come from prefix doubling, in which only
suffixes that still tie are sorted again. A run of LEAST words or more has a root that agrees with what follows it for 8 words, which
the ranks of the third doubling tell: only texts with such a candidate need LCP arrays and reversed texts. The sparse table is made level by
level, and each level answers the queries of its width, so two levels are held at a time.

Scale: documents are independent, one pass, no shuffle. Memory follows a step of 4 MB, or one longer text.

Defined results: null and empty texts and those of white space have no words and no runs; a null doc_id is not changed by the
periodic rule; rows that repeat are repeated, and equal texts have equal runs under one doc_id; ties of exponents go to the
smallest start, then period; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

#: A run has LEAST words, and TIMES its period, at least.
LEAST, TIMES = 24, 3


def sure(least: int, times: int) -> int:
    """A power of two: the first root of a run of period q agrees with what follows it for so many words at least, as the run has
    `least` words and `times` * q, and fewer than 2 * q of them are before and in that root."""
    words = min(max(least - 2 * q + 1, (times - 2) * q + 1) for q in range(1, least + 1))
    return 1 << words.bit_length() - 1


def periodic(doc: int | None, n: int) -> np.ndarray | None:
    """Places that the words of a document are taken from, where its hash makes it periodic."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


class Suffixes:
    """Ranks of the suffixes of texts that stand behind one another, each before a place of its own (its end). s: words as numbers,
    and -1 at ends. `same` tells by place which suffixes have their first `depth` words (a power of two) in common."""

    def __init__(self, s: np.ndarray, depth: int):
        end = s < 0
        doc = np.cumsum(np.r_[False, end[:-1]])
        self.s, self.doc, self.end = s, doc, end
        n = len(s)
        first = doc << 32 | s + 1
        order = np.argsort(first, kind="stable")
        held = first[order]
        fresh = np.r_[True, held[1:] != held[:-1]]
        group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = group
        size = np.diff(np.r_[np.flatnonzero(fresh), n])
        todo = order[np.repeat(size, size) > 1]  # in the order of their ranks
        k, self.same = 1, rank.copy()
        while len(todo):
            own, then = rank[todo], rank[todo + k]  # a tie has k equal words, so the text goes on to its end at least
            order = np.lexsort((then, own))
            todo, own, then = todo[order], own[order], then[order]
            place = np.arange(len(todo))
            new_own = np.r_[True, own[1:] != own[:-1]]
            fresh = new_own | np.r_[True, then[1:] != then[:-1]]
            starts = np.maximum.accumulate(np.where(fresh, place, 0))
            rank[todo] = own + starts - np.maximum.accumulate(np.where(new_own, place, 0))
            size = np.diff(np.r_[np.flatnonzero(fresh), len(todo)])
            todo = todo[np.repeat(size, size) > 1]
            k *= 2
            if k <= depth:
                self.same = rank.copy()
        self.rank = rank

    def lcp(self) -> np.ndarray:
        """Common words of each suffix, by rank, with the one before; 0 between texts."""
        n = len(self.s)
        at = np.empty(n, np.int64)
        at[self.rank] = np.arange(n)
        before = np.full(n, -1)
        same = self.doc[at[1:]] == self.doc[at[:-1]]
        before[at[1:][same]] = at[:-1][same]
        out, s, h = [0] * n, self.s.tolist(), 0
        for i, j in enumerate(before.tolist()):
            if j < 0:
                h = 0
                continue
            while s[i + h] == s[j + h]:  # ends are alone in their text, so one of the two differs there
                h += 1
            out[i] = h
            if h:
                h -= 1
        return np.array(out, np.int64)[at]

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on, which are different places of one text."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        width = high - low
        level = np.frexp(width)[1] - 1
        out = np.empty(len(i), np.int64)
        table, step = self.lcp(), 1
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                table = np.minimum(table[:-step], table[step:])
                step *= 2
            now = np.flatnonzero(level == k)
            out[now] = np.minimum(table[low[now]], table[high[now] - step])
        return out


def lyndon_ends(rank: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
    """By place, where the longest Lyndon word from there ends, under the order and then under the opposite one: the next smaller and
    the next greater rank, or the text's end. The opposite order is that of the negative ranks, in which ends come first too."""
    for sign in (1, -1):
        value = np.where(end, -len(rank) - 1, sign * rank).tolist()
        after = list(range(1, len(value) + 1))
        for i in range(len(value) - 2, -1, -1):
            own, j = value[i], i + 1
            while value[j] > own:
                j = after[j]
            after[i] = j
        yield np.array(after)


def runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (words as numbers, from 0), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return out
    depth = sure(least, times)
    s = np.concatenate([x for t in texts for x in (t, [-1])]).astype(np.int64)
    own = Suffixes(s, depth)
    doc, end = own.doc, own.end
    i, j = _candidates(own)
    if not len(i):
        return out
    held = np.isin(doc, doc[i])  # texts that have candidates go on alone
    if not held.all():
        shift = np.cumsum(held) - 1
        s, doc, end, i, j = s[held], doc[held], end[held], shift[i], shift[j]
        own = Suffixes(s, depth)
    n = len(s)
    back, mirror = Suffixes(np.r_[s[:-1][::-1], -1], depth), n - 2 - np.arange(n)
    forth, behind = own.extensions(i, j), np.zeros(len(i), np.int64)
    inner = np.flatnonzero(~end[i - 1])  # place -1 is an end as well
    behind[inner] = back.extensions(mirror[i[inner] - 1], mirror[j[inner] - 1])
    period = j - i
    start, length = i - behind, period + forth + behind
    good = length >= np.maximum(least, times * period)
    begin = np.maximum.accumulate(np.where(np.r_[True, end[:-1]], np.arange(n), 0))
    for d, a, p, m in np.unique(np.c_[doc[i], start - begin[i], period, length][good], axis=0).tolist():
        out[d].append((a, m, p))
    return out


def _candidates(own: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places and ends of the Lyndon words that agree with what follows them for as many words as a run's root does."""
    inside, found = np.flatnonzero(~own.end), []
    for ends in lyndon_ends(own.rank, own.end):
        i, j = inside, ends[inside]
        keep = own.same[i] == own.same[j]  # an end is like no word
        found.append((i[keep], j[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The places that stay when each run is collapsed to its first period."""
    change = np.zeros(n + 1, np.int64)
    for a, m, p in found:
        change[a + p] += 1
        change[a + m] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


KIND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def scan_runs(docs: DataFrame, *, plant: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row. plant: documents whose hash says so are
    made periodic first."""
    cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("periodic_runs")
        for b in _base.steps(batches):
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            split, coded = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own = text.split()  # at ASCII white space
                at = periodic(doc, len(own)) if plant else None
                if at is not None:
                    own = list(map(own.__getitem__, at.tolist()))
                split.append(own)
                coded.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
            found = runs(coded, least, times)
            collapsed = [b" ".join(map(w.__getitem__, kept_words(len(w), r).tolist()) if r else w) for w, r in zip(split, found, strict=True)]
            cells = [[{"start": a, "length": m, "period": p} for a, m, p in r] for r in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(len, split), pa.int64()), pa.array(cells, pa.list_(cell)), pa.array(collapsed, pa.binary()).view(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return _base.texts(docs).mapInArrow(scan, KIND)


def _before(x: Column, y: Column) -> Column:
    """Which of two runs comes first: the greater exponent, then the smaller start, then the smaller period."""
    a, b = x["length"] * y["period"], y["length"] * x["period"]
    order = F.when(a != b, F.when(a > b, -1).otherwise(1))
    for name in ("start", "period"):
        order = order.when(x[name] != y[name], F.when(x[name] < y[name], -1).otherwise(1))
    return order.otherwise(0)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_runs(_base.table(spark, sf_dir, "documents"), plant=True)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", _before), 0).alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Benchmark decontamination with a generalised suffix automaton.

Words of all test items make a generalised suffix automaton (one automaton of several word sequences). A document's words are
streamed through it, and at each word the length of the longest match that ends there is known: WINDOW or more words mean that a
window of an item ends there, and the state at that length tells which items hold it. An item of fewer words is one window; a state
knows the nearest state on its suffix links where such an item ends. Words inside a window are hit; spans of hit words are cut out of
a text, and a document goes as a whole where more than a share of its words is hit.

Items are cut into pieces that overlap by WINDOW - 1 words, so no window is lost, and pieces are dealt to automata of at most SHARD
words by a hash; the sizes are counted, and there are more automata until each fits. One task builds one automaton. Documents pass
all automata, one after the other; each is broadcast, as SHARD bounds its size (about 35 MB), and nothing else of the test set is. A
usual test set fits into one automaton, so documents are read once, without shuffle.

Defined results: null and empty texts have no words and no hits, of documents as of items; items that repeat count once, and items
with a null id hit but are not named; equal windows of several items name them all; rows of documents that repeat are repeated, and a
null doc_id is one like any other; a text of any length is streamed whole; without documents the result is empty, without items
nothing is hit; other columns are carried (decontaminate) or ignored (op12), whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

#: Words of a window.
WINDOW = 10
#: Words of the items of one automaton at most.
SHARD = 1 << 19
#: A document goes where more than this share of its words is hit.
COVERAGE = 0.5

#: Letters A-Z become a-z, other ASCII than letters and digits a space; bytes of other characters stay.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Bits of a word's number in a key of the transitions.
BITS = 24

Span = tuple[int, int]


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLDED).split()


@dataclass
class Packed:
    """An automaton in arrays: transitions (state << BITS | word, to), by state its length and link, the items of windows by state,
    short items by state."""

    window: int
    vocabulary: list[bytes]
    keys: np.ndarray
    to: np.ndarray
    length: np.ndarray
    link: np.ndarray
    holders: dict[int, tuple[int, ...]]
    short: dict[int, tuple[tuple[int, int], ...]]
    names: list[str | None]


class Builder:
    """A generalised suffix automaton that grows by words."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The state of exactly `state`'s words and this one; a part of a longer state is made its own."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        own = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = own
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = own
            state = self.link[state]
        return own

    def extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        own, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = own
            state = self.link[state]
        if state >= 0:
            self.link[own] = self._split(state, word)
        return own


def build(items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Packed:
    """The automaton of items (name, words)."""
    own, number, names = Builder(), {}, []
    coded = []
    for name, given in items:
        ids = [number.setdefault(w, len(number)) for w in given]
        if ids:
            names.append(name)
            coded.append(ids)
            state = 0
            for w in ids:
                state = own.extend(state, w)
    keys = np.fromiter((s << BITS | w for s, after in enumerate(own.next) for w in after), np.int64)
    to = np.fromiter((t for after in own.next for t in after.values()), np.int32)
    packed = Packed(window, list(number), keys, to, np.array(own.length, np.int32), np.array(own.link, np.int32), {}, {}, names)
    reader, holders, short = Reader(packed), {}, {}
    for k, ids in enumerate(coded):
        for i, (state, length) in enumerate(reader.stream(ids)):
            if length >= window:
                holders.setdefault(reader.anchor[state], {})[k] = None
            elif len(ids) < window and i + 1 == len(ids):
                short.setdefault(state, []).append((len(ids), k))
    packed.holders = {s: tuple(h) for s, h in holders.items()}
    packed.short = {s: tuple(h) for s, h in short.items()}
    return packed


class Reader:
    """A packed automaton, ready to stream documents."""

    def __init__(self, packed: Packed):
        self.window, self.names, self.holders, self.short = packed.window, packed.names, packed.holders, packed.short
        self.number = {w: i for i, w in enumerate(packed.vocabulary)}
        self.after = dict(zip(packed.keys.tolist(), packed.to.tolist(), strict=True))
        self.length, self.link = packed.length.tolist(), packed.link.tolist()
        # links lead to shorter states
        order = np.argsort(packed.length, kind="stable").tolist()
        #: The state on the links that has WINDOW words, by state of as many or more; the nearest state where a short item ends.
        self.anchor, self.ends = [-1] * len(order), [-1] * len(order)
        for s in order[1:]:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.anchor[s] = s if self.length[up] < self.window else self.anchor[up]
            self.ends[s] = s if s in self.short else self.ends[up]

    def stream(self, ids: Iterable[int | None]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match at each word."""
        after, link, lengths = self.after.get, self.link, self.length
        state = length = 0
        for w in ids:
            if w is None:
                state = length = 0
            else:
                to = after(state << BITS | w)
                while to is None and state:
                    state = link[state]
                    length = lengths[state]
                    to = after(state << BITS | w)
                if to is None:
                    length = 0
                else:
                    state, length = to, length + 1
            yield state, length

    def hits(self, given: list[bytes]) -> tuple[list[Span], set[int]]:
        """Spans of hit words, and the items whose windows occur."""
        ids = list(map(self.number.get, given))
        spans: list[Span] = []
        found: set[int] = set()
        window, ends = self.window, self.ends
        for i, (state, length) in enumerate(self.stream(ids)):
            if length < window and ends[state] < 0:
                continue
            most = 0
            if length >= window:
                most = window
                found.update(self.holders[self.anchor[state]])
            at = ends[state]
            while at >= 0:
                for n, item in self.short[at]:
                    if n <= length:
                        most = max(most, n)
                        found.add(item)
                at = ends[self.link[at]]
            if most:
                spans.append((i + 1 - most, i + 1))
        return merged(spans), found


def merged(spans: list[Span]) -> list[Span]:
    """The same words in the fewest spans."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[Span]) -> bytes:
    """The text without the spans' words and what stands between these."""
    at = [m.span() for m in WORD.finditer(raw.translate(FOLDED))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]])


@lru_cache(maxsize=1)
def _opened(packed: bytes) -> Reader:
    return Reader(pickle.loads(packed))


def automata(benchmark: DataFrame, shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """shard and automaton (packed) of the items (item_id, text), written to the shared folder."""
    spark, root = benchmark.sparkSession, _base.scratch(benchmark.sparkSession)
    _base.ship(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    most = max(window, shard // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = words(text)
                for i in range(0, max(1, len(own) - window + 1), most):
                    part = own[i : i + most + window - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(part)], pa.binary()), pa.array([len(part)], pa.int64())], ["item", "words", "n"])

    pieces = _base.written(items.mapInArrow(cut, "item string, words binary, n long").where("n > 0").distinct(), f"{root}/pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    count = 1 if total <= shard else -(-2 * total // shard)
    dealt = lambda k: F.pmod(F.xxhash64("item", "words"), F.lit(k)).cast("int").alias("shard")
    while count > 1 and pieces.groupBy(dealt(count)).agg(F.sum("n").alias("n")).where(F.col("n") > shard).count():
        count *= 2

    def made(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("words").to_pylist(), part.column("item").to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
        return pa.table({"shard": part.column("shard")[:1], "automaton": pa.array([pickle.dumps(build([(i, w.split()) for w, i in rows], window))], pa.binary())})

    # a group holds `shard` words at most, as counted
    return _base.written(pieces.select("*", dealt(count)).groupBy("shard").applyInArrow(made, "shard int, automaton binary"), f"{root}/automata")


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], names: list[str], *, cleaned: bool = False, shard: int = SHARD, window: int = WINDOW) -> DataFrame:
    """The columns of docs in `keep`, and under four new names: the number of words, the spans of hit words, the items, and (with
    `cleaned`) the text without the spans."""
    spark = docs.sparkSession
    _base.ship(spark)
    n_words, spans, found, clean = names
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(clean))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    kind += f"{', ' if kind else ''}`{n_words}` long, `{spans}` array<struct<start: long, end: long>>, `{found}` array<string>"
    cell = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    built = automata(benchmark, shard, window)
    shards = sorted(r["shard"] for r in built.select("shard").collect()) or [None]
    for k in shards:
        raw = pickle.dumps(build([])) if k is None else built.where(F.col("shard") == k).first()["automaton"]
        told, last = spark.sparkContext.broadcast(bytes(raw)), k == shards[-1]  # bounded by `shard` words

        def run(batches: Iterator[pa.RecordBatch], told=told, last=last) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            _base.only("decontamination")
            for whole in batches:
                for b in _base.steps([whole], clean):
                    own, texts = _opened(told.value), b.column(clean).cast(pa.binary()).to_pylist()
                    before = zip(b.column(spans).to_pylist(), b.column(found).to_pylist(), strict=True) if spans in b.schema.names else [([], [])] * len(texts)
                    sizes, hit, items, out = [], [], [], []
                    for raw, (old, known) in zip(texts, before, strict=True):
                        given = words(raw)
                        now, more = own.hits(given)
                        now = merged([*now, *((s["start"], s["end"]) for s in old)])
                        sizes.append(len(given))
                        hit.append([{"start": x, "end": y} for x, y in now])
                        items.append(sorted({*known, *(own.names[i] for i in more if own.names[i] is not None)}))
                        out.append(without(raw, now) if now and last and cleaned else raw)
                    cells = [*(b.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(hit, cell), pa.array(items, pa.list_(pa.string()))]
                    with_text = cleaned or not last
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(out, pa.binary()).view(pa.string())] if with_text else cells, [*keep, n_words, spans, found, *([clean] if with_text else [])])

        rows = rows.mapInArrow(run, kind + (f", `{clean}` string" if cleaned or not last else ""))
        if not last:
            rows = _base.written(rows, f"{_base.scratch(spark)}/pass")
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, without the passages of test items; those with more than `coverage` of their words in
    such passages go."""
    names = _base.fresh(docs, "n_words", "spans", "items", "cleaned")
    found = scan(docs, benchmark, docs.columns, names, cleaned=True, window=window)
    n_words, spans, _, clean = (F.col(n) for n in names)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    left = found.where((n_words == 0) | (hit <= coverage * n_words))
    return left.select(*(F.when(F.size(spans) > 0, clean).otherwise(F.col("text")).alias("text") if c == "text" else c for c in docs.columns))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs, _base.table(spark, sf_dir, "benchmark"), ["doc_id"], ["n_words", "spans", "items", "cleaned"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH i AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[p : p + least(len(w), {WINDOW}) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, p, n, item FROM dw JOIN iw USING (n, g)),
a AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
b AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)
"""

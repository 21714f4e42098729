"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers encode a text; their tokens are intervals of bytes that cover it. The starts and ends of the B tokens are a static
interval index: two bisections per A token give the B tokens that overlap it, its links. A gap between A tokens that no link spans is a
group boundary, so groups are the smallest stretches that both tokenizers cut alike.

Links are counted over the corpus: how many documents hold a pair of ids linked. Texts are encoded once; the facts of each document
(numbers, the digest of its groups, its distinct pairs with how often they occur) are written, and the counts come from them by a
partial aggregation. Then each document meets the counts of its pairs: the HOT most common pairs are broadcast as sorted arrays, about
17 MB at most, and looked up where the facts are read; if there are more pairs, rows of the others, which few documents hold, are
joined by pair and added up by document. No key is hot there, and no document moves.

Defined results: texts that are null or empty, or that one tokenizer does not give back byte for byte behind a space, have no
tokens: zeros, and an empty digest; rows that repeat are documents of their own, and a null doc_id is one like any other; ties of
counts are all the highest; texts are encoded whole, however long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import _base, bpe

#: Pairs whose counts are broadcast, at most.
HOT = 1 << 20
#: What a piece has for a space.
SPACE = "▁"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Aligned:
    """Ids of both sides; by A token, its first B token and the one after its last; by group, the places after its last A and B token."""

    a: np.ndarray
    b: np.ndarray
    first: np.ndarray
    last: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By A token, the range of B tokens (first, behind the last) that overlap it. Sizes in bytes, 1 or more, of equal sums."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    return np.searchsorted(b_ends, a_ends - a_sizes, "right"), np.searchsorted(b_ends - b_sizes, a_ends, "left")


class Pair:
    """Two tokenizers: A byte-level, of a file for `tokenizers`; B of pieces with byte fallback, of a file for `sentencepiece`."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = bpe.Encoder(a_path)
        self.a.tok.encode_special_tokens = True  # their strings in a text are plain text
        self.a.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = self.a.table()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.sizes = len(self.a_bytes), len(self.b_bytes)
        self.a_length, self.b_length = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        most = max(self.sizes)
        #: Decimal ids before each separator.
        self.names = [b"%d%b" % (i, sign) for sign in (b",", b"|", b";") for i in range(most)]
        self.most = most

    def align(self, text: str) -> Aligned | None:
        """None where a tokenizer does not give the bytes back."""
        if not text:
            return None
        raw = b" " + text.encode("utf-8", "surrogatepass")
        a = np.frombuffer(self.a.encode(" " + text), self.a.dtype).astype(np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw:
            return None
        plain = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, plain)) != raw:
            return None
        b = np.array(plain, np.int64)
        first, last = overlaps(self.a_length[a], self.b_length[b])
        a_ends = np.flatnonzero(np.r_[first[1:] == last[:-1], True]) + 1
        return Aligned(a, b, first, last, a_ends, last[a_ends - 1])

    def pairs(self, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs, as a * (number of B ids) + b, and how often each occurs."""
        n = found.last - found.first
        b = np.arange(n.sum()) + np.repeat(found.first - np.cumsum(n) + n, n)
        return np.unique(np.repeat(found.a, n) * self.sizes[1] + found.b[b], return_counts=True)

    def digest(self, found: Aligned) -> str:
        """sha256 of the groups: ids of A, then of B, as in a1,a2|b1;a3|b2,b3."""
        a_last, b_last = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
        a_last[found.a_ends - 1] = b_last[found.b_ends - 1] = 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        out = np.empty(len(found.a) + len(found.b), np.int64)
        out[np.arange(len(found.a)) + np.r_[0, found.b_ends][a_group]] = found.a + self.most * a_last
        out[np.arange(len(found.b)) + found.a_ends[b_group]] = found.b + 2 * self.most * b_last
        return hashlib.sha256(b"".join(map(self.names.__getitem__, out.tolist()))[:-1]).hexdigest()


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, the ids of both sides, and by group the places after its last A and B token."""
    paths = (a_path or default_paths()[0], b_path or default_paths()[1])
    cell = pa.list_(pa.struct([("a_end", pa.int64()), ("b_end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("alignment")
        own = _pair(*paths)
        for b in _base.steps(batches):
            found = [own.align(t) for t in b.column("text").to_pylist()]
            ids = [pa.array([getattr(f, side) if f else [] for f in found], pa.list_(pa.int32())) for side in "ab"]
            groups = [[{"a_end": x, "b_end": y} for x, y in zip(f.a_ends.tolist(), f.b_ends.tolist(), strict=True)] if f else [] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *ids, pa.array(groups, cell)], ["doc_id", "a_ids", "b_ids", "groups"])

    return _base.texts(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_end: long, b_end: long>>")


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def linked(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """The facts of each document: doc_id, numbers, groups_sha256, distinct pairs and times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("alignment")
        own, none = _pair(*paths), np.zeros(0, np.int64)
        for b in _base.steps(batches):
            numbers, told, pairs, times = [], [], [], []
            for text in b.column("text").to_pylist():
                found = own.align(text)
                numbers.append((len(found.a), len(found.b), len(found.a_ends), int((found.last - found.first).sum())) if found else (0, 0, 0, 0))
                told.append(own.digest(found) if found else "")
                p, t = own.pairs(found) if found else (none, none)
                pairs.append(p)
                times.append(t)
            columns = [pa.array([n[k] for n in numbers], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *columns, pa.array(told, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", *NUMBERS, "groups_sha256", "pairs", "times"],
            )

    return _base.texts(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(facts: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no pair of its A id has more)."""
    counts = facts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair div {b_size}")))  # an A id has at most one row for each B id
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def _least_hot(counts: DataFrame, hot: int) -> int:
    """A count that at most `hot` pairs reach."""
    level = F.floor(F.log2("n") * 4).cast("int")
    found = sorted(((r["k"], r["c"], r["least"]) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()), reverse=True)  # four rows for each doubling
    held, least = 0, (found[0][2] if found else 0) + (1 << 62)
    for _, c, n in found:
        held += c
        if held > hot:
            break
        least = n
    return least


def with_counts(facts: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """The facts (a written table with `row`, which is different in every row) without pairs, with n_best and count_sum."""
    spark, least = facts.sparkSession, _least_hot(counts, hot)
    known = counts.where(F.col("n") >= least).toArrow().sort_by("pair")  # at most `hot` rows
    told = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "best")))
    given = [c for c in facts.columns if c not in ("pairs", "times")]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in facts.schema if f.name in given)
    rest = counts.where(F.col("n") < least)
    cold = not rest.isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("alignment")
        pair, n, best = told.value
        for b in batches:
            own = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times")]
            ends = np.cumsum(np.r_[0, b.column("pairs").value_lengths().to_numpy(zero_copy_only=False)])
            at = np.minimum(np.searchsorted(pair, own[0]), max(0, len(pair) - 1))
            held = pair[at] == own[0] if len(pair) else np.zeros(len(own[0]), bool)
            sums = []
            for value in (best, n) if len(pair) else ():
                weight = np.where(held, value[at] * own[1].astype(np.int64), 0)
                sums.append(np.diff(np.r_[0, np.cumsum(weight)][ends]))
            sums = sums or [np.zeros(b.num_rows, np.int64)] * 2
            out = [*(b.column(c) for c in given), *(pa.array(s, pa.int64()) for s in sums)]
            if cold:
                offsets = pa.array(np.r_[0, np.cumsum(~held)][ends], pa.int32())
                out += [pa.ListArray.from_arrays(offsets, pa.array(x[~held], kind)) for x, kind in zip(own, (pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(out, [*given, "n_best", "count_sum", *(["pairs", "times"] if cold else [])])

    done = facts.mapInArrow(run, f"{kind}, n_best long, count_sum long" + (", pairs array<long>, times array<int>" if cold else ""))
    if not cold:
        return done
    done = _base.written(done, f"{_base.scratch(spark)}/told")
    rows = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))
    more = rows.join(rest, "pair").groupBy("row").agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    out = done.drop("pairs", "times").join(more, "row", "left")
    return out.select(*given, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def aligned_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, groups_sha256, n_best and count_sum of every row."""
    spark, paths = docs.sparkSession, (a_path or default_paths()[0], b_path or default_paths()[1])
    root = _base.scratch(spark)
    facts = _base.written(linked(docs, paths).withColumn("row", F.monotonically_increasing_id()), f"{root}/facts")
    counts = _base.written(pair_counts(facts, _pair(*paths).sizes[1]), f"{root}/counts")
    return with_counts(facts, counts, hot).drop("row")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned_counts(_base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")

"""Exact dedup by a log-structured merge index.

Memtables collect (digest, document) entries per partition and flush them as runs sorted by digest. Digests fall into ranges by
their first bits, and compaction deals the runs out by range: each range has a tree of sorted levels with a Bloom filter each. A
run that arrives is tested against the filters; entries that a filter lets through are looked up in that level by binary search,
and a hit leaves the better row there (most code points in the original text, then smallest doc_id) and adds up the count. The
others become a level, and levels of like size merge. What the tree ends with is one sorted run a range, a level on disk. `add` puts a further batch into an index beside the levels that are there and merges them all once there are
more than FANOUT; `probe` finds the rows of new documents whose digest some level holds, asking a filter of each level first.

Documents whose digest is held more than once are hits, and a hit's normalised bytes are compared with those of the row that
stays; a row that differs (a digest collision) is grouped again by its bytes.

Scale: one pass reads the texts and shuffles 32-byte digests only; the number of ranges follows the number of entries, so that a
range's tree (about 90 bytes an entry) fits a worker at any size; a digest that many rows have arrives at most once a memtable. A
second pass sends on only the texts of hits, found by a broadcast filter of at most sieve.MOST bits. The text of the row that
stays is copied once per SHARE members of its group and each member goes to one of these copies, so that a group of any size
spreads over many tasks.

Defined results: null text counts as empty, and all empty texts are equal; rows that repeat a doc_id are separate members
of their group (all rows with the winner's doc_id are marked kept); a null doc_id ranks after all others; an empty table gives an
empty result; a text is in memory whole, at most a few megabytes of texts beside it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base, sieve

#: The characters that equality ignores.
SPACE = b" \t\n\x0b\x0c\r"
#: Entries of a memtable before it is flushed, where texts are read and where runs are merged.
MEMTABLE = 200_000
SMALL_MEMTABLE = 8192
#: Entries of a range, about.
RANGE = 1 << 20
#: Levels on disk before they are merged.
FANOUT = 4
#: Members of a group that meet one copy of the text that stays.
SHARE = 512
#: Stands for a null doc_id in numpy, so that it ranks last.
NONE = np.iinfo(np.int64).max

ENTRY = "digest binary, doc_id long, n_cp long, text_key long"
RUN = "range int, digest binary, doc_id long, n_cp long, n long"


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _base.only("exact_dedup")
    for b in batches:
        got = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(normalise(t)).digest() for t in got], pa.binary()),
                b.column("doc_id"),
                pa.array([len(t) for t in got], pa.int64()),
                b.column("text_key"),
            ],
            ["digest", "doc_id", "n_cp", "text_key"],
        )


class Run:
    """Entries with different digests in their order: digests as four big-endian words each, document, its code points, rows."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, n_cp: np.ndarray, n: np.ndarray):
        self.words, self.doc, self.n_cp, self.n = words, doc, n_cp, n

    def __len__(self) -> int:
        return len(self.doc)

    @staticmethod
    def of(digests: bytes, doc: np.ndarray, n_cp: np.ndarray, n: np.ndarray) -> Run:
        """Sorts entries, and makes one of those with one digest: the best row, all rows counted."""
        words = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 4)
        order = np.lexsort((doc, -n_cp, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
        words, doc, n_cp, n = words[order], doc[order], n_cp[order], n[order]
        first = np.ones(len(doc), bool)
        first[1:] = (words[1:] != words[:-1]).any(axis=1)
        at = np.flatnonzero(first)
        return Run(words[at], doc[at], n_cp[at], np.add.reduceat(n, at) if len(at) else n)

    def take(self, which: np.ndarray) -> Run:
        return Run(self.words[which], self.doc[which], self.n_cp[which], self.n[which])

    def digests(self) -> list[bytes]:
        raw = self.words.astype(">u8").tobytes()
        return [raw[i : i + 32] for i in range(0, len(raw), 32)]

    def batch(self, place: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(place.astype(np.int32)), pa.array(self.digests(), pa.binary()), pa.array(self.doc, mask=self.doc == NONE), pa.array(self.n_cp), pa.array(self.n)],
            ["range", "digest", "doc_id", "n_cp", "n"],
        )


class Level(Run):
    """A run that can be looked up, with its filter."""

    def __init__(self, run: Run):
        super().__init__(run.words, run.doc, run.n_cp, run.n)
        self.mask = np.zeros(sieve.bits_for(len(run)) // 8, np.uint8)
        at = sieve.places(self.words[:, 0].view(np.int64), len(self.mask) * 8).ravel()
        np.bitwise_or.at(self.mask, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def maybe(self, run: Run) -> np.ndarray:
        """The places in `run` that the filter lets through."""
        return np.flatnonzero(sieve.test(self.mask, run.words[:, 0].view(np.int64)))

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each digest, -1 where it isn't held."""
        at = np.searchsorted(self.words[:, 0], words[:, 0])
        found = np.full(len(words), -1)
        left = np.arange(len(words))
        while len(left):
            left = left[at[left] < len(self)]
            left = left[self.words[at[left], 0] == words[left, 0]]
            same = (self.words[at[left]] == words[left]).all(axis=1)
            found[left[same]] = at[left[same]]
            left = left[~same]
            at[left] += 1
        return found


class Tree:
    """Levels of falling size. looked: how many entries were searched for in a level, after its filter."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.looked = 0

    def add(self, run: Run) -> None:
        for level in self.levels:
            maybe = level.maybe(run)
            if not len(maybe):
                continue
            self.looked += len(maybe)
            at = level.find(run.words[maybe])
            hit, at = maybe[at >= 0], at[at >= 0]
            level.n[at] += run.n[hit]
            better = (run.n_cp[hit] > level.n_cp[at]) | (run.n_cp[hit] == level.n_cp[at]) & (run.doc[hit] < level.doc[at])
            level.n_cp[at[better]], level.doc[at[better]] = run.n_cp[hit[better]], run.doc[hit[better]]
            run = run.take(np.setdiff1d(np.arange(len(run)), hit, assume_unique=True))
        if len(run):
            self.levels.append(Level(run))
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 >= len(self.levels[-2]):
            self._merge()

    def _merge(self) -> None:
        a, b = self.levels[-2:]
        self.levels[-2:] = [Level(Run.of(a.words.astype(">u8").tobytes() + b.words.astype(">u8").tobytes(), *(np.concatenate([x, y]) for x, y in ((a.doc, b.doc), (a.n_cp, b.n_cp), (a.n, b.n)))))]

    def end(self) -> Level | None:
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0] if self.levels else None


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _collected(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Run]:
    """Memtables of `most` rows or a batch more; the entries of a memtable as a run."""
    held: list[tuple] = []
    n = 0

    def run() -> Run:
        return Run.of(b"".join(h[0] for h in held), *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)))

    for b in batches:
        held.append((b"".join(b.column("digest").to_pylist()), _numbers(b, "doc_id"), _numbers(b, "n_cp"), _numbers(b, "n") if "n" in b.schema.names else np.ones(b.num_rows, np.int64)))
        n += b.num_rows
        if n >= most:
            yield run()
            held, n = [], 0
    if n:
        yield run()


def _flush(entries: DataFrame, bits: int) -> DataFrame:
    """Runs of entries, each sorted, with the range of each digest: its first `bits` bits."""

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _collected(batches, MEMTABLE):
            yield run.batch(run.words[:, 0] >> np.uint64(64 - bits))

    return entries.select("digest", "doc_id", "n_cp").mapInArrow(flush, RUN)


def merge(runs: DataFrame, ranges: int) -> DataFrame:
    """One sorted run for each range."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}

        def by_range() -> Iterator[tuple[int, pa.RecordBatch]]:
            for b in batches:
                place = b.column("range").to_numpy()
                for r in np.unique(place).tolist():
                    yield r, b.filter(pa.array(place == r))

        held: dict[int, list[pa.RecordBatch]] = {}
        for r, b in by_range():
            own = held.setdefault(r, [])
            own.append(b)
            if sum(x.num_rows for x in own) >= SMALL_MEMTABLE:
                for run in _collected(iter(held.pop(r)), SMALL_MEMTABLE):
                    trees.setdefault(r, Tree()).add(run)
        for r, own in held.items():
            for run in _collected(iter(own), SMALL_MEMTABLE):
                trees.setdefault(r, Tree()).add(run)
        for r in sorted(trees):
            level = trees.pop(r).end()
            for i in range(0, len(level), 1 << 16):
                part = level.take(np.arange(i, min(i + (1 << 16), len(level))))
                yield part.batch(np.full(len(part), r))

    return runs.repartitionById(ranges, F.col("range")).mapInArrow(merged, RUN)


class DigestIndex:
    """The index below `root`: entries by document, runs, and levels with their filters. `ranges` is a power of two, by default from
    the size of the first batch."""

    def __init__(self, spark: SparkSession, root: str | None = None, ranges: int | None = None):
        self.spark, self.root, self.ranges = spark, root or _base.scratch(spark), ranges
        self.entries: DataFrame | None = None
        self.levels: list[DataFrame] = []
        self.filters: dict[int, bytes] = {}
        self.batches = 0

    def add(self, docs: DataFrame) -> DigestIndex:
        """Puts a batch of documents into the index."""
        at = f"{self.root}/batch{self.batches}"
        self.batches += 1
        own = _base.written(entries(docs), f"{at}/entries")
        if self.ranges is None:
            least = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // RANGE))
            self.ranges = 1 << max(1, (least - 1).bit_length())
        runs = _base.written(_flush(own, self.ranges.bit_length() - 1), f"{at}/runs")
        self.levels.append(_base.written(merge(runs, self.ranges), f"{at}/level"))
        self.entries = own if self.entries is None else self.entries.unionByName(own)
        if len(self.levels) > FANOUT:
            self.compact()
        return self

    def filter(self, i: int) -> bytes:
        """The filter of a level, made when it is first asked."""
        if i not in self.filters:
            self.filters[i] = hit_filter(self.levels[i])
        return self.filters[i]

    def compact(self) -> None:
        """Merges all levels into one."""
        if len(self.levels) > 1:
            rows = self.levels[0]
            for level in self.levels[1:]:
                rows = rows.unionByName(level)
            self.levels = [_base.written(merge(rows, self.ranges), f"{self.root}/batch{self.batches - 1}/merged")]
            self.filters = {}

    def hits(self) -> DataFrame:
        """Digests that more than one row has."""
        self.compact()
        return self.levels[0].where("n > 1")

    def probe(self, docs: DataFrame) -> DataFrame:
        """doc_id and held_id (of the row that the index keeps) of the documents whose digest is in the index, by digest alone; the
        index stays as it is. Only digests that a level's filter lets through are looked up."""
        new = entries(docs)
        found = None
        for i, level in enumerate(self.levels):  # FANOUT at most
            maybe, _ = sieve.split(new, _prefix(F.col("digest")), self.filter(i))
            own = maybe.join(level.select("digest", F.col("doc_id").alias("held_id"), F.col("n_cp").alias("held_cp")), "digest")
            found = own if found is None else found.unionByName(own)
        best = F.min(F.struct(-F.col("held_cp"), F.col("held_id").isNull(), F.col("held_id").alias("held_id"))).alias("b")
        return found.groupBy("doc_id", "text_key", "digest").agg(best).select("doc_id", "b.held_id")


def entries(docs: DataFrame) -> DataFrame:
    """digest, doc_id, n_cp, and text_key (a hash of the text, to tell rows of one doc_id apart) of every row."""
    given = _base.texts(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return given.mapInArrow(lambda it: _entries(_base.steps(it)), ENTRY)


def _prefix(digest: Column) -> Column:
    """The first eight bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _short(digests: list[bytes]) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)


def hit_filter(rows: DataFrame) -> bytes:
    """A filter of the digests of a written table."""
    return sieve.build(rows.select("digest"), lambda b: _short(b.column("digest").to_pylist()))


def _hit_texts(docs: DataFrame, mask: bytes) -> DataFrame:
    """digest, doc_id and normalised bytes of the documents that the filter lets through."""
    told = docs.sparkSession.sparkContext.broadcast(mask)  # sieve.MOST bits at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("exact_dedup")
        m = np.frombuffer(told.value, np.uint8)
        for b in _base.steps(batches):
            raw = [normalise(t) for t in b.column("text").to_pylist()]
            digests = [hashlib.sha256(r).digest() for r in raw]
            if not digests:
                continue
            keep = np.flatnonzero(sieve.test(m, _short(digests))).tolist()
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in keep], pa.binary()), b.column("doc_id").take(pa.array(keep)), pa.array([raw[i] for i in keep], pa.binary())],
                    ["digest", "doc_id", "raw"],
                )

    return _base.texts(docs).mapInArrow(found, "digest binary, doc_id long, raw binary")


def verify(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits whose bytes differ from those of the row that stays: digest, doc_id, raw. Empty unless digests collide."""
    root = _base.scratch(docs.sparkSession)
    # both written, as each is read several times; a digest that very many rows have gets its facts where its rows are
    rows = _base.written(_hit_texts(docs, hit_filter(hits)), f"{root}/texts")
    copies = F.ceil(F.col("n") / SHARE).cast("int")
    stay = _base.written(hits.select("digest", F.col("n").alias("k"), F.col("doc_id").alias("stay_id"), copies.alias("copies")), f"{root}/stay")
    member = _base.attach(rows, stay, "digest", rows.count()).drop("k")
    texts = (
        member.where("doc_id <=> stay_id").groupBy("digest", "copies").agg(F.first("raw").alias("stay_raw"))
        .select("digest", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "stay_raw")
    )
    dealt = member.select("digest", "doc_id", "raw", F.expr("cast(pmod(xxhash64(doc_id, 7), copies) as int)").alias("copy"))
    return dealt.join(texts, ["digest", "copy"]).where("raw <> stay_raw").select("digest", "doc_id", "raw")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_cp and text_key for every row."""
    index = DigestIndex(docs.sparkSession).add(docs)
    hits = index.hits()
    differ = _base.written(verify(docs, hits), f"{index.root}/differ")
    own = hits.select("digest", F.col("doc_id").alias("stay_id"), "n")
    out = (
        index.entries.join(own, "digest", "left")
        .select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("stay_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            "n_cp",
            "text_key",
        )
    )
    if not differ.isEmpty():
        out = _split_collisions(out, differ)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_cp", "text_key")


def _split_collisions(out: DataFrame, differ: DataFrame) -> DataFrame:
    """Groups the rows whose bytes differ from the row that stays by their bytes, and takes them from their old group."""
    odd = differ.select("doc_id", F.lower(F.hex("digest")).alias("text_sha256"), "raw").distinct()
    lost = out.join(odd, ["doc_id", "text_sha256"])
    again = lost.groupBy("text_sha256", "raw").agg(F.min(F.struct(-F.col("n_cp"), F.col("doc_id").alias("doc_id"))).alias("b"), F.count("*").alias("m"))
    moved = lost.join(again, ["text_sha256", "raw"]).select("doc_id", "text_sha256", F.col("b.doc_id").alias("to"), "m")
    less = lost.groupBy("text_sha256").agg(F.count("*").alias("gone"))
    return (
        out.join(moved.distinct(), ["doc_id", "text_sha256"], "left").join(less, "text_sha256", "left")
        .select("doc_id", F.coalesce("to", "keep_id").alias("keep_id"), F.coalesce("m", F.col("group_size") - F.coalesce("gone", F.lit(0))).cast("long").alias("group_size"), "text_sha256", "n_cp", "text_key")
    )


#: DuckDB SQL for the rows of op4.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS t FROM documents
), s AS (SELECT doc_id, length(text) AS n_cp, sha256(t) AS text_sha256 FROM d)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept,
  text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id)
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_base.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")

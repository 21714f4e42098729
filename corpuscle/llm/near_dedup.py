"""Near-duplicates: a multi-index Hamming join over MinHash signatures, confirmed on full shingle sets.

A document's set holds the hashes of its distinct runs of SHINGLE words. Its signature has SYMBOLS symbols of 16 bits, each
from the smallest value of one hash function over the set, so two sets of similarity s differ in about (1 - s) * SYMBOLS
symbols. The signature is split into CHUNKS chunks. By the pigeonhole principle two signatures that differ in at most
MOST = CHUNKS * (ERRORS + 1) - 1 symbols have a chunk with at most ERRORS = 1 differing symbol; each chunk is indexed once for
every symbol that may differ (the other three must be equal), which finds all pairs up to that distance. At similarity 0.8
the distance has mean 9.6 and deviation 2.8; MOST = 23 is missed by about three pairs in a million.

Equal sets are one class before anything is compared: a class is a digest of 128 bits, and classes get numbers when their table
is written. Words are hashed by steps without linear structure, so no family of words collides. Two classes are linked if
their signatures differ in at most MOST symbols and their full sets are similar, in buckets of every size alike. Only the way
pairs are listed depends on the bucket: of one with at most SMALL classes all pairs are; in a larger one those are left out
that can't be similar, without looking at them: a similarity of at least 0.8 needs a common element among the first fifth of
either set in any one order. Rare elements come first in the order (by a sketch of counts of fixed size), so that what many
documents share, such as a passage, is no key; in what is left each element's classes are compared with one centre, and after
that only classes that are not yet in one component. Links give components.

Scale: two passes over the texts; the first shuffles signatures and 48 keys of 16 bytes a class, the second sends on only sets
of classes that have a candidate. Buckets are never collected beyond SMALL. The facts
of elements with very many rows are broadcast (_base.attach bounds them); pairs are made in shares of SHARE classes, which spread.

Defined results: fewer words than SHINGLE make one shingle; documents without words (also null and empty texts) have an empty
set, link with nothing and are kept; rows that repeat are one class (all rows with the smallest doc_id are marked kept), and so
are rows that repeat a doc_id with other text, each by its own set; a null doc_id is carried and never the name of a component
that has another; an empty table gives an empty result; other columns are ignored. A text is cut into words a step at a time;
its set of hashes is in memory at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base, sieve
from corpuscle.llm.components import components

SHINGLE = 4
#: Similarity of linked documents, in per cent.
SIMILAR = 80
CHUNKS, WIDTH, ERRORS = 12, 4, 1
SYMBOLS = CHUNKS * WIDTH
MOST = CHUNKS * (ERRORS + 1) - 1
SMALL = 32
#: Counters of the sketch; fixed, so that what is broadcast does not grow with the data.
SKETCH = 1 << 18
SKETCH_SLICE = 1 << 12
#: Text bytes of a step.
STEP = 1 << 20

#: Classes of a share of an element.
SHARE = 512
#: Bytes of a word that are hashed eight at a time.
LONG = 64

SIGNED = "doc_id long, text_key long, n_shingles long, class binary, sig binary"

M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on each other."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors for the words of a shingle; offsets and odd factors of the hash functions."""
    rng = np.random.default_rng(80)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(16), odd(SYMBOLS), odd(SYMBOLS)


BREAK = re.compile(rb"[ \t-\r]")


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are white space; masks for the first n bytes of eight."""
    spaces = np.zeros(256, bool)
    spaces[[32, *range(9, 14)]] = True
    return spaces, np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in lower-cased bytes, and their hashes: eight bytes at a time through a bijection, so that words of up to eight
    bytes differ for certain if they are as long; words of more than LONG bytes by a cryptographic hash."""
    spaces, masks = _bytes()
    whole = b"\n" + raw + b"\n" + bytes(8)
    space = spaces[np.frombuffer(whole, np.uint8, len(raw) + 2)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(raw) + 2,), "<u8", buffer=whole, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(0, LONG, 8):
            at = np.flatnonzero(size > k) if k else slice(None)
            part = eight[starts[at] + k] & masks[np.minimum(size[at] - k, 8)]
            if not len(part):
                break
            out[at] = mix(out[at] * np.uint64(0xD6E8FEB86659FD93) ^ part)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(whole[starts[i] : starts[i] + size[i]], digest_size=8).digest(), "little")
    return starts - 1, out


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words in order; A-Z count as a-z. A long text is cut at white space, a step at a time."""
    raw, out, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > STEP:
            cut = BREAK.search(raw, at + STEP)
            end = cut.start() if cut else end
        out.append(_hashes(raw[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _words(texts: list[str]) -> tuple[np.ndarray, list[int]]:
    """The hashes of all texts' words, and where each text's end."""
    if sum(len(t or "") for t in texts) > 2 * STEP:
        own = [word_hashes(t) for t in texts]
        return np.concatenate(own), np.cumsum([len(x) for x in own]).tolist()
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    starts, words = _hashes(b"\n".join(raw))
    return words, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw])).tolist()


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    words, ends = _words(texts)
    factors = _constants()[0]
    with np.errstate(over="ignore"):
        n = max(0, len(words) - shingle + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(shingle):
            runs += words[k : k + n] * factors[k]
        runs = mix(runs)
        out = []
        for s, e in zip([0, *ends][:-1], ends, strict=True):
            if e - s >= shingle:
                out.append(np.unique(runs[s : e - shingle + 1]))
            elif e > s:
                total = (words[s:e] * factors[: e - s]).sum(dtype=np.uint64) + np.uint64(e - s)
                out.append(mix(mix(np.array([total]))))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signature(found: np.ndarray) -> np.ndarray:
    """16-bit symbols of a set that is not empty."""
    _, offsets, factors = _constants()
    least = np.full(SYMBOLS, M64, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 2048):
            part = found[i : i + 2048]
            np.minimum(least, ((part[None, :] ^ offsets[:, None]) * factors[:, None]).min(axis=1), out=least)
        return (mix(least) >> np.uint64(48)).astype("<u2")


def keys_of(signs: np.ndarray) -> np.ndarray:
    """For each row of symbols, a key for each chunk and each symbol of it that may differ."""
    parts = signs.astype(np.int64).reshape(-1, CHUNKS, WIDTH)
    out = np.empty((len(parts), CHUNKS, WIDTH), np.int64)
    for free in range(WIDTH):
        a, b, c = (parts[:, :, k] for k in range(WIDTH) if k != free)
        out[:, :, free] = (np.arange(CHUNKS) * WIDTH + free)[None, :] << 48 | a << 32 | b << 16 | c
    return out.reshape(len(parts), CHUNKS * WIDTH)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text, to tell rows of one doc_id apart), n_shingles, class (of equal sets) and sig; the last
    two null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("near_dedup")
        for b in _base.steps(batches, most=STEP):
            found = shingle_sets(b.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_key"), pa.array(map(len, found), pa.int64()), pa.array([class_digest(x) if len(x) else None for x in found], pa.binary()),
                    pa.array([signature(x).tobytes() if len(x) else None for x in found], pa.binary()),
                ],
                ["doc_id", "text_key", "n_shingles", "class", "sig"],
            )

    return _base.texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SIGNED)


def _keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                keys = keys_of(np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("cid").to_numpy(), keys.shape[1]))], ["key", "cid"])

    return classes.select("cid", "sig").mapInArrow(run, "key long, cid long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b and d, the signatures' distance, of the pairs with d <= MOST whose sizes allow the similarity."""
    own = lambda x: classes.select(F.col("cid").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, SYMBOLS) for c in ("sa", "sb"))
                d = (x != y).sum(axis=1)
                keep = pa.array(d <= MOST)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(d.astype(np.int32))], ["a", "b", "d"]).filter(keep)

    both = pairs.join(own("a"), "a").join(own("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILAR)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, d int")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """cid and items (sorted shingle hashes) of the wanted classes (cid, class, doc_id; a written table), from one document each."""

    mask = sieve.build(wanted.select("class", "doc_id"), lambda b: _row_keys(b.column("class").to_pylist(), b.column("doc_id")))
    told = docs.sparkSession.sparkContext.broadcast(mask)  # sieve.MOST bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(told.value, np.uint8)
        for b in _base.steps(batches, most=STEP):
            found = shingle_sets(b.column("text").to_pylist(), shingle)
            digests = [class_digest(x) for x in found]
            ok = sieve.test(mask, _row_keys(digests, b.column("doc_id")))
            keep = [i for i in np.flatnonzero(ok).tolist() if len(found[i])]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], ["class", "items"])

    rows = _base.texts(docs).mapInArrow(run, "class binary, items array<long>")
    return rows.join(wanted.select("cid", "class"), "class").select("cid", "items").dropDuplicates(["cid"])


def _row_keys(digests: list[bytes], docs: pa.Array) -> np.ndarray:
    """A class's digest and a doc_id (null as 0) as one number."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8") ^ docs.fill_null(0).to_numpy(zero_copy_only=False)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    own = lambda x: sets.select(F.col("cid").alias(x), F.col("items").alias(f"i{x}"))
    both = pairs.select("a", "b").distinct().join(own("a"), "a").join(own("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ia", "ib")).alias("shared"), (F.size("ia") + F.size("ib")).alias("total"))
    return both.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * SIMILAR).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _sketch(sets: DataFrame) -> bytes:
    """Counts of the elements of all sets, SKETCH counters of 4 bytes."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SKETCH, np.int64)
        for b in batches:
            own += np.bincount(b.column("items").flatten().to_numpy().view(np.uint64) & np.uint64(SKETCH - 1), minlength=SKETCH)
        if own.any():
            rows = np.minimum(own, 1 << 30).astype("<i4").reshape(-1, SKETCH_SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["slice", "n"])

    def added(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in part.column("n").to_pylist())
        return pa.table({"slice": part.column("slice")[:1], "n": pa.array([np.minimum(total, 1 << 30).astype("<i4").tobytes()], pa.binary())})

    rows = sets.select("items").mapInArrow(some, "slice long, n binary").groupBy("slice").applyInArrow(added, "slice long, n binary").collect()  # 4 * SKETCH bytes
    out = bytearray(4 * SKETCH)
    for r in rows:
        out[r["slice"] * 4 * SKETCH_SLICE : (r["slice"] + 1) * 4 * SKETCH_SLICE] = r["n"]
    return bytes(out)


def _prefixes(sets: DataFrame) -> DataFrame:
    """item, cid, pos, n: the elements of which similar sets must have one in common, rare ones first."""
    told = sets.sparkSession.sparkContext.broadcast(_sketch(sets))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(told.value, "<i4")
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                items, cids, places, sizes = [], [], [], []
                ends = b.column("items").offsets.to_numpy()
                flat = b.column("items").values.to_numpy()
                for cid, s, e in zip(b.column("cid").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = flat[s:e].view(np.uint64)
                    n = e - s
                    m = n - -(-n * SIMILAR // 100) + 1
                    first = np.lexsort((own, counts[own & np.uint64(SKETCH - 1)]))[:m]
                    items.append(own[first].view(np.int64)), cids.append(np.full(m, cid)), places.append(np.arange(m)), sizes.append(np.full(m, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (items, cids, places, sizes)], ["item", "cid", "pos", "n"])

    return sets.select("cid", "items").mapInArrow(run, "item long, cid long, pos long, n long")


def _possible(x: str, y: str):  # noqa: ANN202
    """Whether sizes and places of the first common element leave room for the similarity."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * SIMILAR) & (F.least(n - i, m - j) * (100 + SIMILAR) >= (n + m) * SIMILAR)


@dataclass
class Found:
    """Documents with their class, classes, and the links between classes."""

    signed: DataFrame
    classes: DataFrame
    links: DataFrame
    root: str


def find_links(docs: DataFrame, shingle: int = SHINGLE) -> Found:
    spark = docs.sparkSession
    root = _base.scratch(spark)
    signed = _base.written(signatures(docs, shingle), f"{root}/signed")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n_shingles", "sig")).alias("r")
    classes = signed.where("class is not null").groupBy("class").agg(one, F.count("*").alias("rows"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "class", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.sig", "rows")
    classes = _base.written(classes, f"{root}/classes")  # the numbers hold from here on

    keys = _keys(classes)
    shared = _base.written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), f"{root}/shared")
    members = _base.written(keys.join(shared, "key"), f"{root}/members")
    lists = members.where(f"c <= {SMALL}").groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("l"))
    ab = F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as a, y as b))))")).alias("p")
    pairs = lists.select(ab).select("p.a", "p.b").distinct()
    near = _base.written(_near(pairs, classes), f"{root}/near")
    hot = _base.written(members.where(f"c > {SMALL}").select("cid").distinct(), f"{root}/hot")

    involved = near.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(hot).distinct()
    wanted = _base.written(classes.select("cid", "class", "doc_id").join(involved, "cid", "left_semi"), f"{root}/wanted")
    sets = _base.written(_sets(docs, wanted, shingle), f"{root}/sets")

    # each class with its nearest candidate, and each rare element's classes with one centre
    best = lambda x, y: near.groupBy(F.col(x).alias("a")).agg(F.min(F.struct("d", F.col(y).alias("b"))).alias("m")).select("a", "m.b")
    first = best("a", "b").unionByName(best("b", "a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rare = None
    if not hot.isEmpty():
        rare = _prefixes(sets.join(hot, "cid", "left_semi"))
        rare = _base.written(rare, f"{root}/prefixes")
        facts = rare.groupBy("item").agg(F.count("*").alias("k"), F.min(F.struct("pos", "cid", "n")).alias("centre")).where("k > 1")
        rare = _base.written(_base.attach(rare, _base.written(facts, f"{root}/centres"), "item", rare.count()), f"{root}/rare")
        stars = rare.alias("x").where(_possible("x", "centre") & (F.col("x.cid") != F.col("centre.cid")))
        stars = stars.select(F.least("x.cid", "centre.cid").alias("a"), F.greatest("x.cid", "centre.cid").alias("b")).distinct()
        first = first.unionByName(_near(stars, classes).select("a", "b"))
    first = _base.written(first.distinct(), f"{root}/first")
    links = _base.written(verify(first, sets), f"{root}/links1")

    # what is left: candidates that are not yet in one component
    comp = components(links, f"{root}/some")
    placed = lambda df, x: df.join(comp.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), x, "left").withColumn(f"_{x}", F.coalesce(f"_{x}", x))
    apart = placed(placed(near.select("a", "b"), "a"), "b").where("_a <> _b").select("a", "b")
    if rare is not None:
        dealt = placed(rare.select("item", "cid", "pos", "n"), "cid").withColumnRenamed("_cid", "part")
        dealt = _base.written(dealt, f"{root}/dealt")
        facts = dealt.groupBy("item").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("item", "k", F.ceil(F.col("k") / SHARE).cast("int").alias("shares"))
        facts = _base.written(facts, f"{root}/split")
        dealt = _base.written(_base.attach(dealt, facts, "item", dealt.count()), f"{root}/between")
        x = dealt.withColumn("share", F.pmod(F.xxhash64("cid"), F.col("shares")).cast("int")).alias("x")
        y = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).alias("y")
        more = x.join(y.hint("merge"), (F.col("x.item") == F.col("y.item")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.part") != F.col("y.part")) & _possible("x", "y"))
        more = more.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
        apart = apart.unionByName(_near(more, classes).select("a", "b"))
    rest = _base.written(apart.distinct().join(first.hint("merge"), ["a", "b"], "left_anti"), f"{root}/apart")
    links = _base.written(links.unionByName(verify(rest, sets)), f"{root}/links")
    return Found(signed, classes, links, root)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's smallest doc_id) and kept; text_key, and group: the component's number, null
    for a row that has none beside it."""
    found = find_links(docs, shingle)
    comp = components(found.links, f"{found.root}/all")
    nodes = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.join(found.classes.select(F.col("cid").alias("node"), "doc_id"), "node")
    of = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = nodes.join(of, "root").select(F.col("node").alias("cid"), "component_id", F.col("root").alias("group"))
    groups = found.classes.select("cid", "class", "doc_id", "rows").join(linked, "cid", "left").where("rows > 1 or component_id is not null")
    groups = groups.select("class", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("group", "cid").alias("group"))
    groups = _base.written(groups, f"{found.root}/groups")
    out = found.signed.join(groups, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "group")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: DuckDB SQL for the rows of op2: all shingles in common, then all that can be reached.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, t.b FROM r JOIN t ON r.c = t.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

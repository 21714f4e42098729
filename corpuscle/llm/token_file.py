"""Token-ID files of directly addressable codes.

A block splits ids into levels of 8 bits, the lowest first. Level k holds the k-th byte of every id that is long enough, a
bitmap that says which of its ids go on, and a rank directory (ones before each 512 bits). The byte of an id in the next
level stands at the rank of its bit, so one id, or a run of ids, is read without decoding what is before it.

Files are Parquet tables of blocks in the shared folder (written by Spark's committer, so a task that runs again leaves
nothing twice): shard, places of the block's ids in its shard, the block's directory of documents, and the block. Cells are not
compressed, and row groups are small, so that the statistics of the places lead a reader to the row groups it needs. Shards are
ranges of doc_id, ids ascend by doc_id within and between them. TokenFile finds the shard and the block of a token's position in
the whole file, for one run of ids or for a table of positions.

Scale: texts are encoded where they are read, and one exchange moves two bytes an id to shards whose bounds come from
quantiles of doc_id; their number follows the size of the input. A block holds about BLOCK ids, and a task packs one at a time;
the driver gets one count per shard.

Defined results: null and empty texts have the end id alone; rows with one doc_id follow each other by their ids, and a null
doc_id comes first (-2**63, which stands for it, is no doc_id); a document is one run of ids, so a very long one makes a longer
block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base, bpe

#: Ids of a block; a document is never split, so a longer one makes a longer block.
BLOCK = 1 << 18
END_ID = 0
#: Units that the encoder remembers; nothing else is kept here, so there is room for more.
UNITS = 800_000
MAGIC = b"DAC1"
#: Bits between entries of a rank directory.
RANK = 512

#: Bytes of text that make a shard, about.
SHARD = 1 << 28
#: Bytes of a row group, about; stands for a null doc_id.
GROUP = 1 << 20
NONE = np.iinfo(np.int64).min

#: start and stop: the block's first id and the one after its last, counted in the shard.
FILE = "shard int, start long, stop long, doc_ids binary, lengths binary, block binary"


def write_block(ids: np.ndarray) -> bytes:
    """The block of an array of unsigned ids."""
    left, levels = ids.astype(np.uint32), []
    while True:
        low, left = (left & 255).astype(np.uint8), left >> np.uint32(8)
        more = left > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, RANK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(struct.pack("<I", len(low)) + low.tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        left = left[more]
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Block:
    """Random access to a written block."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        (n,) = struct.unpack_from("<I", raw, 4)
        at, self.levels = 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", raw, at)
            words = -(-size // RANK)
            low = np.frombuffer(raw, np.uint8, size, at + 4)
            bits = np.frombuffer(raw, np.uint8, words * RANK // 8, at + 4 + size)
            ranks = np.frombuffer(raw, "<u4", words, at + 4 + size + len(bits))
            self.levels.append((low, bits, ranks))
            at += 4 + size + len(bits) + 4 * words

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        word = i // RANK
        if word >= len(ranks):
            word = len(ranks) - 1
            if word < 0:
                return 0
        here = bits[word * RANK // 8 : i // 8]
        n = int(ranks[word]) + int(np.bitwise_count(here).sum())
        return n + (int(bits[i // 8]) & (1 << i % 8) - 1).bit_count() if i % 8 else n

    def get(self, i: int) -> int:
        out = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            out |= int(low[i]) << 8 * k
            if not bits[i // 8] >> i % 8 & 1:
                return out
            i = self._rank(bits, ranks, i)
        return out

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, exclusive."""
        out = np.zeros(stop - start, "<u4")
        where = None
        for k, (low, bits, ranks) in enumerate(self.levels):
            part = low[start:stop].astype("<u4") << np.uint32(8 * k)
            if where is None:
                out |= part
            else:
                out[where] |= part
            on = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            if not on.any():
                break
            where = np.flatnonzero(on) if where is None else where[on]
            first = self._rank(bits, ranks, start)
            start, stop = first, first + len(where)
        return out


def _bounds(docs: DataFrame, least: int) -> list[int]:
    """Ascending bounds between shards of about equal rows: `least` shards, or as many as SHARD bytes of text each make."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(least, -(-size // SHARD))
    if n < 2:
        return []
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = told.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    return sorted({int(x) for x in found})


def write_tokens(docs: DataFrame, root: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes every document, appends the end id, and writes the files below `root`; the table of blocks."""
    spark = docs.sparkSession
    path = path or bpe.default_vocabulary()
    bounds = np.array(_bounds(docs, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))), np.int64)
    shards = len(bounds) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("token_file")
        own = bpe.encoder(path, UNITS)
        end = own.pack([END_ID])
        for b in _base.steps(batches):
            got = [own.encode(t) + end for t in b.column("text").to_pylist()]
            doc = b.column("doc_id").fill_null(NONE)
            shard = np.searchsorted(bounds, doc.to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), doc, pa.array(got, pa.binary())], ["shard", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = bpe.encoder(path, UNITS).dtype
        shard, start, held, docs, sizes, n = -1, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([start + n], pa.int64()), pa.array([np.array(docs, "<i8").tobytes()], pa.binary()),
                    pa.array([np.array(sizes, "<i8").tobytes()], pa.binary()), pa.array([write_block(np.frombuffer(b"".join(held), kind))], pa.binary()),
                ],
                ["shard", "start", "stop", "doc_ids", "lengths", "block"],
            )

        for b in batches:
            for s, doc, ids in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if held and (s != shard or n + len(ids) // kind.itemsize > BLOCK):
                    yield block()
                    start = start + n if s == shard else 0
                    held, docs, sizes, n = [], [], [], 0
                shard = s
                held.append(ids)
                docs.append(doc)
                sizes.append(len(ids) // kind.itemsize)
                n += sizes[-1]
        if held:
            yield block()

    coded = _base.texts(docs).mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    options = {"compression": "uncompressed", "parquet.block.size": str(GROUP), "parquet.enable.dictionary": "false"}
    return _base.written(dealt.mapInArrow(pack, FILE), f"{root}/blocks", **options)


def shard_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids of all documents before each shard: one row per shard comes to the driver."""
    out, total = {}, 0
    for r in blocks.groupBy("shard").agg(F.max("stop").alias("n")).orderBy("shard").collect():
        out[r["shard"]] = total
        total += r["n"]
    return out


class TokenFile:
    """The ids of a table of blocks by their position in the whole file."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.begins = shard_starts(blocks)
        self.size = (lambda r: self.begins[r["shard"]] + r["stop"] if r else 0)(blocks.orderBy(F.desc("shard"), F.desc("stop")).select("shard", "stop").first())

    def _blocks(self, start: int, stop: int) -> DataFrame:
        """The blocks that hold positions from start to stop: filters on places, which Parquet's statistics answer."""
        where = F.lit(False)
        shards = sorted(self.begins)
        for shard, after in zip(shards, [*(self.begins[s] for s in shards[1:]), self.size], strict=True):
            if self.begins[shard] < stop and after > start:
                where = where | (F.col("shard") == shard) & (F.col("start") < stop - self.begins[shard]) & (F.col("stop") > start - self.begins[shard])
        return self.blocks.where(where)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids at positions from start to stop, exclusive; only that many come to the driver."""
        if not 0 <= start <= stop <= self.size:
            raise IndexError(f"positions run from 0 to {self.size}")
        begins = self.begins

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    first = begins[r["shard"]] + r["start"]
                    block = Block(r["block"])
                    ids = block.read(max(0, start - first), min(len(block), stop - first))
                    yield pa.RecordBatch.from_arrays([pa.array([max(start, first)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["at", "ids"])

        if start == stop:
            return np.zeros(0, "<u4")
        rows = self._blocks(start, stop).select("shard", "start", "block").mapInArrow(cut, "at long, ids binary").collect()
        return np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(rows, key=lambda r: r["at"])])

    def get(self, position: int) -> int:
        return int(self.read(position, position + 1)[0])

    def lookup(self, positions: DataFrame) -> DataFrame:
        """position and id of the different positions in a table (one long column); those beyond the file are left out. Positions meet
        the directory of blocks by buckets of BLOCK places, and each block, of which only the asked ids are read, meets its own."""
        shards = np.array(sorted(self.begins), np.int32)
        firsts = np.array([self.begins[s] for s in shards.tolist()], np.int64)  # one number a shard
        size = self.size

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = b.column(0).cast(pa.int64()).drop_null().to_numpy(zero_copy_only=False)
                p = np.unique(p[(p >= 0) & (p < size)])
                at = np.searchsorted(firsts, p, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(shards[at]), pa.array(p - firsts[at])], ["position", "shard", "place"])

        asked = positions.mapInArrow(placed, "position long, shard int, place long").distinct().withColumn("bucket", F.expr(f"place div {BLOCK}"))
        table = self.blocks.select("shard", "start", "stop", F.explode(F.expr(f"sequence(start div {BLOCK}, (stop - 1) div {BLOCK})")).alias("bucket"))
        met = asked.join(table, ["shard", "bucket"]).where("place >= start and place < stop")
        own = met.groupBy("shard", "start").agg(F.collect_list(F.struct("position", (F.col("place") - F.col("start")).alias("i"))).alias("asked"))  # at most a block's ids

        def got(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    block = Block(r["block"])
                    yield pa.RecordBatch.from_arrays([pa.array([x["position"] for x in r["asked"]], pa.int64()), pa.array([block.get(x["i"]) for x in r["asked"]], pa.int64())], ["position", "id"])

        return self.blocks.select("shard", "start", "block").join(own, ["shard", "start"]).select("block", "asked").mapInArrow(got, "position long, id long")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    begins = shard_starts(blocks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block, sizes = Block(r["block"]), np.frombuffer(r["lengths"], "<i8")
                ends, ids = np.cumsum(sizes), block.read(0, len(block))  # all of it is wanted here, so its levels are put together once
                crcs = [zlib.crc32(ids[e - n : e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                starts = begins[r["shard"]] + r["start"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs := np.frombuffer(r["doc_ids"], "<i8"), mask=docs == NONE), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _base.scratch(spark)
    return read_tokens(write_tokens(_base.table(spark, sf_dir, "documents"), root))

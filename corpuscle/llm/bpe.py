"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling (gear) hash over the bytes cuts a text into chunks of about CHUNK bytes at places that depend on the content only, so
that a passage which many documents share falls into the same chunks in each. Chunks that occur more than once anywhere are
encoded once for all documents: one pass over the texts gives the digests of their chunks, which are counted; a second sends on
one copy of each shared chunk, which is encoded and written; then each text meets the ids of its shared chunks, and encodes what
stands between them itself.

What stands at a chunk's ends can encode differently next to other text. A chunk's ids are therefore kept from its first to its
last inner unit, where units are cut at spaces before non-spaces, and the join of two chunks is repaired: the text from the last
unit of one to the first unit of the other is encoded again by the tokenizer itself, and taken if it begins with the ids that one
chunk has for its unit and ends with those of the other. If not, the window grows by both chunks and ends at their neighbours' units,
until both sides agree, at last over the whole text. Chunks of fewer than WORTH bytes (mostly texts or ends of texts) are not shared, since
their digest, join and repair cost more than encoding them; their ids are the same either way. Texts that name a special token, and units with characters above U+024F (whose class may differ
between regex engines), go to the tokenizer as they are.

Memory: a worker remembers the ids of a bounded number of units. Scale: digests of 16 bytes a chunk are shuffled, then the
shared chunks (once a task), their ids, and the texts that have some, which a broadcast filter of at most sieve.MOST bits finds;
the other texts are encoded where they are read. A chunk that very many texts have is broadcast with its ids (_base.attach).

Defined results: null and empty texts have no ids; rows that repeat are repeated; a null doc_id is one like any other; a text is
encoded whole, by chunks, and a text without spaces goes to the tokenizer at once; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base, sieve

#: Mean bytes between cuts, least bytes of a chunk.
CHUNK, LEAST = 1024, 256
#: Bytes of a chunk that is worth sharing, at least.
WORTH = 128
#: Units whose ids a worker remembers.
UNITS = 200_000
#: Digests that a task remembers to send a chunk once.
SEEN = 1 << 16

SAFE = re.compile(r" (?=\S)")
#: White space other than the space and the four common ones, as Python sees it.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Signs that are a pre-token of their own after a word.
SIGNS = frozenset(".,;:!?|")
FAR = re.compile("[^\x00-\u024f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stays, the rest follows from U+0100."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Coded:
    """A chunk: its text up to the first unit, the first and last inner units, the text from the last safe point, ids from first to
    last, and how many of these are the first unit's and the last one's."""

    head: str
    first: str
    last: str
    tail: str
    ids: bytes
    n_first: int
    n_last: int


CODED = "head string, first string, last string, tail string, ids binary, n_first int, n_last int"


class Units(dict):
    """Ids (as little-endian bytes) of " " + unit by unit. The first units that come stay, as common ones come early; after STALE times
    as many as it holds were not among them, the store starts anew."""

    STALE = 4

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.lost = encoder, 0

    def __missing__(self, unit: str) -> bytes:
        found = self.encoder.unit(unit)
        if len(self) < self.encoder.most:
            self[unit] = found
        else:
            self.lost += 1
            if self.lost >= self.STALE * self.encoder.most:
                self.clear()
                self.lost = 0
        return found


class Encoder:
    """The tokenizer of a file, with stores for units and chunks."""

    def __init__(self, path: str, units: int = UNITS):
        self.most = units
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.units = Units(self)
        self.starts: dict[str, bytes] = {}
        visible = _visible()
        self.shown, self.space = visible, visible[32]
        self.hidden = {v: b for b, v in visible.items()}
        self.size = size

    # encoding

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def library(self, text: str) -> bytes:
        return self.pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, part: str) -> bytes:
        """One pre-token."""
        if part.isascii() and part[1:].isalpha() and part[0] == " ":
            shown = self.space + part[1:]
        else:
            shown = part.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def unit(self, unit: str) -> bytes:
        """A word, a word with one sign, or else what the tokenizer's pattern makes of it."""
        if not unit.isascii() and FAR.search(unit):
            return self.library(" " + unit)
        if unit.isalpha():
            return self._word(" " + unit)
        if unit[-1:] in SIGNS and unit[:-1].isalpha():
            return self.units[unit[:-1]] + self.bare(unit[-1])
        parts = self.split(" " + unit)
        if len(parts) == 1:
            return self._word(parts[0])
        return b"".join([self.units[p[1:]] if p[0] == " " and len(p) > 1 else self.bare(p) for p in parts])

    def bare(self, part: str) -> bytes:
        found = self.starts.get(part)
        if found is None:
            if len(self.starts) >= self.most // 4:
                self.starts.clear()
            found = self.starts[part] = self._word(part)
        return found

    def first(self, text: str) -> bytes:
        """Text up to the first safe point."""
        if not text:
            return b""
        if FAR.search(text):
            return self.library(text)
        return b"".join(map(self.bare, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids by units alone."""
        if any(s in text for s in self.special):
            return self.library(text)
        units = cut(text)
        return self.first(units[0]) + b"".join(map(self.units.__getitem__, units[1:]))

    # chunks

    def chunk(self, raw: bytes) -> Coded | None:
        """A chunk by itself; None without an inner unit."""
        units = cut(raw.decode("utf-8", "surrogatepass"))
        if len(units) < 3:
            return None
        ids = list(map(self.units.__getitem__, units[1:-1]))
        width = self.dtype.itemsize
        return Coded(units[0], " " + units[1], " " + units[-2], " " + units[-1], b"".join(ids), len(ids[0]) // width, len(ids[-1]) // width)

    def join(self, left: Coded | None, between: str, right: Coded | None) -> bytes | None:
        """Ids between the inner units of two chunks (or of the text's ends), of a window that agrees with both; None if it does not."""
        got = self.library((left.last + left.tail if left else "") + between + (right.head + right.first if right else ""))
        width = self.dtype.itemsize
        a, b = (left.n_last * width if left else 0), (right.n_first * width if right else 0)
        fits = len(got) >= a + b and (not a or got[:a] == left.ids[-a:]) and (not b or got[-b:] == right.ids[:b])
        return got[a : len(got) - b] if fits else None

    def parts(self, text: str, known: dict[bytes, Coded] | None) -> Iterator[tuple[bytes, Coded | None]]:
        """The chunks that are known, and what stands between them, coded by itself: a text without known chunks is one part."""
        raw, run = text.encode("utf-8", "surrogatepass"), []
        for part in chunks(raw) if known else [raw]:
            found = known.get(digest(part)) if known else None
            if found is None:
                run.append(part)
                continue
            if run:
                yield (own := b"".join(run)), self.chunk(own)
                run = []
            yield part, found
        if run:
            yield (own := b"".join(run)), self.chunk(own)

    def encode_chunked(self, text: str, known: dict[bytes, Coded] | None = None) -> bytes:
        """Ids by chunks, those in `known` (by digest) as they are, and repaired joins."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.library(text)
        held: list[tuple[bytes, bytes, Coded, bytes]] = []  # what stands before a chunk and its ids, the chunk, its bytes
        gap = b""
        for raw, right in chain(self.parts(text, known), [(None, None)]):
            if raw is not None and right is None:
                gap += raw
                continue
            got = self.join(held[-1][2] if held else None, gap.decode("utf-8", "surrogatepass"), right)
            while got is None:  # the window takes in both chunks
                if right:
                    gap, right = gap + raw, None
                if held:
                    before, _, _, own = held.pop()
                    gap = before + own + gap
                if raw is not None:
                    break  # it goes on to the next chunk
                got = self.join(held[-1][2] if held else None, gap.decode("utf-8", "surrogatepass"), None)
            if got is not None:
                held.append((gap, got, right, raw))
                gap = b""
        return b"".join(x for _, got, chunk, _ in held for x in (got, chunk.ids if chunk else b""))

    # decoding

    def table(self) -> list[bytes]:
        """Bytes of each id; special tokens are their own text."""
        if not hasattr(self, "_table"):
            special = self.tok.get_added_tokens_decoder()
            out = []
            for i in range(self.size):
                token = special[i].content.encode() if i in special else None
                if token is None:
                    shown = self.tok.id_to_token(i)
                    token = bytes(map(self.hidden.__getitem__, shown)) if shown is not None else b""
                out.append(token)
            self._table = out
        return self._table

    def names(self) -> list[bytes]:
        """Ids in decimal."""
        if not hasattr(self, "_names"):
            self._names = [str(i).encode() for i in range(self.size)]
        return self._names

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.table().__getitem__, ids)).decode("utf-8", "replace")


def cut(text: str) -> list[str]:
    """The text before the first safe point, then each unit without the space before it."""
    if "  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" ") or ODD_SPACE.search(text):
        return SAFE.split(text)
    return text.split(" ")


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.default_rng(0x5EED).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunks(raw: bytes) -> list[bytes]:
    """Cuts where a hash of the 16 bytes before is 0 modulo CHUNK, LEAST bytes apart, at whole characters."""
    n = len(raw)
    if n <= LEAST:
        return [raw] if raw else []
    b = np.frombuffer(raw, np.uint8)
    h = _gear()[b]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    found = np.flatnonzero(h[15:-1] >> np.uint32(22) == 0) + 16
    found = found[b[found] & 0xC0 != 0x80]
    out, last = [], 0
    for at in found.tolist():
        if at - last >= LEAST:
            out.append(raw[last:at])
            last = at
    out.append(raw[last:])
    return out


@lru_cache(maxsize=4)
def encoder(path: str, units: int = UNITS) -> Encoder:
    """One per worker, file and size of the store of units."""
    return Encoder(path, units)


def _told(own: Encoder, ids: np.ndarray) -> tuple[str, str]:
    """Digests of the ids and of the text decoded from them."""
    plain = ids.tolist()
    text = own.decode(plain)
    return hashlib.sha256(b",".join(map(own.names().__getitem__, plain))).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def _batch(own: Encoder, b: pa.RecordBatch, known: list[dict] | None, columns: list[str]) -> pa.RecordBatch:
    """The named columns of results for a batch of doc_id and text."""
    given = b.column("text").to_pylist()
    got = [np.frombuffer(own.encode_chunked(t, known[i] if known else None), own.dtype) for i, t in enumerate(given)]
    sizes = [len(g) for g in got]
    out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(sizes, pa.int64())}
    if "ids" in columns:
        flat = np.concatenate(got) if got else np.zeros(0, own.dtype)
        out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.astype(np.int32)))
    if "ids_sha256" in columns:
        told = [_told(own, g) for g in got]
        out["ids_sha256"], out["decoded_sha256"] = pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())
    return pa.RecordBatch.from_arrays([out[c] for c in columns], columns)


RESULT = {"doc_id": "long", "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def _marks(texts: DataFrame, path: str) -> DataFrame:
    """text_key and digest of each text's different chunks that are worth sharing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        special = encoder(path).special
        for b in _base.steps(batches):
            keys, digests = [], []
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not any(s in text for s in special):
                    own = {digest(raw) for raw in chunks(text.encode("utf-8", "surrogatepass")) if len(raw) >= WORTH}
                    digests += own
                    keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary())], ["text_key", "digest"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key long, digest binary")


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def _shared_chunks(texts: DataFrame, shared: DataFrame, path: str) -> DataFrame:
    """digest, k and ids of the shared chunks (digest, k; a written table), each encoded once."""
    told = texts.sparkSession.sparkContext.broadcast(sieve.build(shared.select("digest"), lambda b: _short(b.column("digest").to_pylist())))  # sieve.MOST bits at most

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        mask, seen = np.frombuffer(told.value, np.uint8), set()
        for b in _base.steps(batches):
            found = {digest(raw): raw for t in b.column("text").to_pylist() for raw in chunks(t.encode("utf-8", "surrogatepass")) if len(raw) >= WORTH}
            own = [d for d in found if d not in seen]
            if own:
                own = [own[i] for i in np.flatnonzero(sieve.test(mask, _short(own)))]
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([found[d] for d in own], pa.binary())], ["digest", "raw"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        own = encoder(path)
        for b in _base.steps(batches, "raw"):
            got = [own.chunk(r) for r in b.column("raw").to_pylist()]
            keep = [i for i, g in enumerate(got) if g]
            part = b.take(pa.array(keep, pa.int64()))
            names = list(Coded.__dataclass_fields__)
            kinds = {"ids": pa.binary(), "n_first": pa.int32(), "n_last": pa.int32()}
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("k"), *(pa.array([getattr(got[i], n) for i in keep], kinds.get(n, pa.string())) for n in names)], ["digest", "k", *names])

    sent = texts.select("text").mapInArrow(send, "digest binary, raw binary").dropDuplicates(["digest"])
    return sent.join(shared, "digest").select("digest", "k", "raw").mapInArrow(code, f"digest binary, k long, {CODED}")


def _coded(docs: DataFrame, path: str | None, columns: list[str]) -> DataFrame:
    path = path or default_vocabulary()
    spark = docs.sparkSession
    root = _base.scratch(spark)
    texts = _base.texts(docs).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = ", ".join(f"{c} {RESULT[c]}" for c in columns)
    marks = _base.written(_marks(texts, path), f"{root}/marks")
    shared = _base.written(marks.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1"), f"{root}/shared")

    def alone(batches: Iterator[pa.RecordBatch], mask: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        own = encoder(path)
        for b in _base.steps(batches):
            if mask is not None:
                b = b.filter(pa.array(~sieve.test(mask, b.column("text_key").to_numpy())))
            yield _batch(own, b, None, columns)

    if shared.isEmpty():
        return texts.mapInArrow(lambda it: alone(it, None), kind)
    coded = _base.written(_shared_chunks(texts, shared, path), f"{root}/coded")
    met = _base.attach(marks.distinct(), coded, "digest", marks.count())
    parts = met.groupBy("text_key").agg(F.collect_list(F.struct("digest", *Coded.__dataclass_fields__)).alias("parts"))  # those of one text
    parts = _base.written(parts, f"{root}/parts")
    told = spark.sparkContext.broadcast(sieve.build(parts.select("text_key")))  # sieve.MOST bits at most

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(told.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(sieve.test(mask, b.column("text_key").to_numpy())))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return alone(batches, np.frombuffer(told.value, np.uint8))

    def with_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        own = encoder(path)
        for b in _base.steps(batches, most=_base.STEP_BYTES // 4):
            known = [{p.pop("digest"): Coded(**p) for p in row or ()} for row in b.column("parts").to_pylist()]
            yield _batch(own, b, known, columns)

    sharing = texts.mapInArrow(some, "doc_id long, text string, text_key long").join(parts, "text_key", "left")
    return texts.mapInArrow(rest, kind).unionByName(sharing.select("doc_id", "text", "parts").mapInArrow(with_parts, kind))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int). `path` is a vocabulary file that every executor can open."""
    return _coded(docs, path, ["doc_id", "ids"])


def encode_and_decode(docs: DataFrame, path: str | None = None, *, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids if asked for, ids_sha256 (of decimal ids joined by commas), and decoded_sha256 (of the text decoded from
    the ids), by one worker: decoded texts need not go back to the JVM."""
    return _coded(docs, path, [c for c in RESULT if ids or c != "ids"])


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Decodes the column `ids`: the rest stays, and text comes in its place."""
    path = path or default_vocabulary()
    rest = [c for c in coded.columns if c != "ids"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("bpe")
        own = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                ids = b.column("ids")
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                got = [own.decode(flat[s:e].tolist()) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(got, pa.string())], [*rest, "text"])

    return coded.mapInArrow(run, f"{kind}, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_base.table(spark, sf_dir, "documents"), ids=False)

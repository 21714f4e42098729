"""Quality by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A text is cut into pieces of PIECE
bytes, so that it meets the dictionaries and not itself, and each piece is compressed with either dictionary. The difference of
the two compressed sizes, normalised by the text's size, is all that a score is made of: a logistic curve over it, fitted on
labelled rows that the dictionaries did not see, gives a score from 0 to 1.

What is learned comes from at most about TRAIN labelled rows of each class (chosen by a hash of doc_id), half for the
dictionaries, half for the curve. Rows for the dictionaries are taken whole, in the order of that hash, as long as all of a class
hold at most TRAIN_BYTES together; a row that does not fit is left out. Scores read whole texts. Scale: scoring is one pass
without shuffle; the driver gets 2 * TRAIN_BYTES of text at any input size.

Defined results: equal texts have equal scores; null and empty texts get the score of no difference; without labels, or with
those of one class alone, the score is that class's share (1 without any); a label other than 0 and 1 is ignored, and so is a
doc_id that has both, or a null one; rows that repeat are repeated, and texts of one doc_id are learned from together; an empty table gives
an empty result; a text is compressed piece by piece, however long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

PIECE = 256
#: Labelled rows of each class that are learned from, about, and bytes of those for a dictionary, at most.
TRAIN, TRAIN_BYTES = 4000, 16 << 20
DICTIONARY = 112 << 10
#: Bytes of a segment that the dictionary trainer picks.
SEGMENT = 50
LEVEL = 3
#: Rows with this remainder of crc32(doc_id as text) modulo 4 are never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


@dataclass(frozen=True)
class Model:
    """Dictionaries and the curve: bias, weight. share: the score where nothing was learned."""

    good: bytes = b""
    bad: bytes = b""
    bias: float = 0.0
    weight: float = 0.0
    share: float | None = None


class Scorer:
    """Compressors of a model; one per step of work, as they are not shared between threads."""

    def __init__(self, model: Model):
        import zstandard

        def made(raw: bytes) -> zstandard.ZstdCompressor:
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.model = model
        if model.share is None:
            self.good, self.bad = made(model.good).compress, made(model.bad).compress

    def difference(self, text: str | None) -> float:
        """How much smaller the good dictionary makes a text than the bad one, in parts of its size."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        return sum(len(self.bad(p)) - len(self.good(p)) for p in pieces(raw)) / len(raw)

    def score(self, text: str | None) -> float:
        m = self.model
        if m.share is not None:
            return m.share
        x = m.bias + m.weight * self.difference(text)
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), 9)


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train: all of their bytes
        return b"".join(samples)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and weight of a logistic regression by Newton steps on the standardised feature, with a small ridge."""
    mean, std = x.mean(), x.std() + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / std]
    w, ridge = np.zeros(2), 1e-2 * np.eye(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
    return float(w[0] - w[1] / std * mean), float(w[1] / std)


def fold(doc: Column, n: int) -> Column:
    return F.crc32(doc.cast("string").cast("binary")) % n


def chosen(rows: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About `bound` rows of each value of `key`, by a hash of doc_id; all where there are no more."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.join(F.broadcast(counts), key).where(place < F.lit(float(bound)) / F.col("n")).drop("n")


def _order(doc: int) -> tuple[int, int]:
    return doc * 0x9E3779B97F4A7C15 % (1 << 64), doc


def fitting(sizes: list[tuple[int, int, int]], most: int) -> list[int]:
    """The documents (doc_id, quality, bytes) that fit into `most` bytes of their class, in a fixed order."""
    held, out = {0: 0, 1: 0}, []
    for doc, quality, n in sorted(sizes, key=lambda r: _order(r[0])):
        if held[quality] + n <= most:
            held[quality] += n
            out.append(doc)
    return out


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAIN, most: int = TRAIN_BYTES) -> Model:
    """A model of labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).alias("half")
    picked = chosen(known, "quality", bound, 1).select("doc_id", "quality", half)  # about 2 * bound rows
    # written, so that texts are scanned once: sizes, dictionaries and the curve read these rows alone
    rows = _base.written(_base.texts(docs).join(F.broadcast(picked), "doc_id"), f"{_base.scratch(docs.sparkSession)}/rows")

    sizes = rows.where("half = 0").groupBy("doc_id", "quality").agg(F.sum(F.octet_length("text")).alias("n")).collect()  # about bound rows
    ids = fitting([tuple(r) for r in sizes], most)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    found = rows.where("half = 0").join(wanted, "doc_id").select("doc_id", "quality", "text").collect()  # 2 * most bytes
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(found, key=lambda r: (_order(r["doc_id"]), r["text"])):
        samples[r["quality"]] += pieces(r["text"].encode("utf-8", "surrogatepass"))
    if not samples[0] or not samples[1]:
        share = picked.agg(F.avg("quality")).first()[0]
        return Model(share=1.0 if share is None else float(share))
    model = Model(_dictionary(samples[1]), _dictionary(samples[0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("quality")
        own = Scorer(model)
        for b in _base.steps(batches):
            got = [own.difference(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(got, pa.float64())], ["doc_id", "quality", "x"])

    held = rows.where("half = 1").select("doc_id", "quality", "text").mapInArrow(measure, "doc_id long, quality int, x double")
    held = sorted(tuple(r) for r in held.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect())  # about bound rows
    x, y = np.array([h[2] for h in held], float), np.array([h[1] for h in held], float)
    if not len(y) or y.min() == y.max():
        return Model(share=float(y.mean()) if len(y) else 1.0)
    return Model(model.good, model.bad, *_curve(x, y))


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the named columns, and score of every row."""
    given = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text")) if "text" not in keep else docs.select("doc_id", *keep)
    _base.ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes
    names = [c for c in given.columns if c != "text" or "text" in keep]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("quality")
        own = Scorer(told.value)
        for b in _base.steps(batches):
            got = [own.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, pa.float64())], [*names, "score"])

    return given.mapInArrow(run, f"{kind}, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, _base.table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least `threshold`, with all their columns; only the text goes through Python."""
    _base.ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _base.only("quality")
        own = Scorer(told.value)
        for part in parts:
            yield pd.Series([own.score(t) for t in part], dtype="float64")

    return docs.where(score(F.col("text").cast("string")) >= threshold)

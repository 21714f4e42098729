"""Language identification by hyperdimensional profiles.

Each letter has a random vector of DIM signs. An n-gram of three symbols is the product of its letters' vectors, rotated by
two, one and no places; a text is the sum of its n-grams' vectors, a language the sum of its texts' unit vectors, and a text
gets the language whose prototype has the largest cosine. Letters are lower-cased; runs of anything else are one boundary
symbol, which also stands at both ends. Every letter of any script has a vector of its own, made from its code point.

Prototypes are learned from at most about TRAIN rows of each language (by a hash of doc_id). Their texts go to WORKERS
tasks, which add whole-number vectors, so the sum does not depend on the order. Scale: prediction is one pass without
shuffle; the driver gets DIM numbers a language.

Defined results: texts without a letter (also null and empty ones) are `und` with score 0, and so are all where nothing was
learned; ties go to the language that is first by code point; rows that repeat are repeated, and a null doc_id is one like any
other (never learned from); an empty table gives an empty result; a text of any length is one sum over its different n-grams; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base
from corpuscle.llm.quality import chosen, fold

DIM = 1024
SEED = 20240229
TRAIN = 2000
WORKERS = 16
#: Bits of a code point in the code of an n-gram; letters whose vectors a worker keeps, at most (3 * DIM bytes each).
BITS = 21
LETTERS = 1 << 14
#: Whole numbers per unit in sums of unit vectors.
UNIT = 1 << 30
#: Steepness of the score over differences of cosines.
SHARP = 12.0
FOLDS, HELD_OUT = 3, 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


def signs(symbol: int) -> np.ndarray:
    """The vector of a letter (its code point) or of the boundary (0)."""
    return np.random.default_rng([SEED, symbol]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of a text and their counts; None without a letter."""
    if not text:
        return None
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    s = np.where(_letters()[s], s, 0)
    if not s.any():
        return None
    s = np.concatenate([[0], s, [0]])
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
    return np.unique(s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:], return_counts=True)


class Binder:
    """Vectors of n-grams; those of common ones are kept, up to MOST."""

    MOST = 30_000

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.kept = np.empty((self.MOST, DIM), np.int8)
        #: Vectors of letters, rotated by two, one and no places, and where each letter's are.
        self.table, self.letter = np.empty((3, 64, DIM), np.int8), {}

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """Where the symbols' vectors stand in the table of letters."""
        found, at = np.unique(symbols, return_inverse=True)
        new = [s for s in found.tolist() if s not in self.letter]
        if len(self.letter) + len(new) > LETTERS:
            self.letter, new = {}, found.tolist()
        for s in new:
            n = len(self.letter)
            if n == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.empty_like(self.table)], axis=1)
            self.table[:, n] = [np.roll(signs(s), k) for k in (2, 1, 0)]
            self.letter[s] = n
        return np.fromiter(map(self.letter.__getitem__, found.tolist()), np.int64, len(found))[at]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        """Products of the letters' vectors, rotated by two, one and no places."""
        low = (1 << BITS) - 1
        at = self.rows(np.concatenate([codes >> 2 * BITS, codes >> BITS & low, codes & low])).reshape(3, -1)
        out = self.table[0][at[0]]
        for k in (1, 2):
            out *= self.table[k][at[k]]
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        wanted = codes.tolist()
        new = [c for c in wanted if c not in self.place]
        if new and len(self.place) + len(new) <= self.MOST:
            n = len(self.place)
            for i in range(0, len(new), 512):
                self.kept[n + i : n + i + len(new[i : i + 512])] = self.bind(np.array(new[i : i + 512]))
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
        at = np.fromiter((self.place.get(c, -1) for c in wanted), np.int64, len(wanted))
        out = np.zeros(DIM, np.float32)
        weight = counts.astype(np.float32)
        held = np.flatnonzero(at >= 0)
        for i in range(0, len(held), 512):
            part = held[i : i + 512]
            out += weight[part] @ self.kept[at[part]].astype(np.float32)
        rest = np.flatnonzero(at < 0)
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            out += weight[part] @ self.bind(codes[part]).astype(np.float32)
        return out

    def vector(self, text: str | None) -> np.ndarray | None:
        """The text's unit vector."""
        found = ngrams(text)
        if found is None:
            return None
        out = self.bundle(*found).astype(np.float64)
        size = np.linalg.norm(out)
        return out / size if size else None


@lru_cache(maxsize=1)
def binder() -> Binder:
    return Binder()


def learn(docs: DataFrame, bound: int = TRAIN) -> dict[str, np.ndarray]:
    """Prototypes (unit vectors) by language, from rows outside the held-out fold."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = ids.where(F.col("label").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = chosen(ids, "label", bound, 3).select("label", "text").repartition(WORKERS)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("languages")
        own, sums = binder(), {}
        for b in _base.steps(batches):
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                v = own.vector(text)
                if v is not None:
                    sums.setdefault(label, np.zeros(DIM, np.int64))
                    sums[label] += np.rint(v * UNIT).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["label", "v"])

    def added(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in part.column("v").to_pylist())
        return pa.table({"label": part.column("label")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    found = rows.mapInArrow(some, "label string, v binary").groupBy("label").applyInArrow(added, "label string, v binary").collect()
    out = {}
    for r in sorted(found, key=lambda r: r["label"]):
        v = np.frombuffer(r["v"], np.int64).astype(np.float64)
        if v.any():
            out[r["label"]] = v / np.linalg.norm(v)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score and cosine (to the language predicted)."""
    names = list(prototypes)
    told = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names]).reshape(len(names), DIM))  # DIM numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.only("languages")
        own, known = binder(), told.value
        for b in _base.steps(batches):
            langs, scores, near = [], [], []
            for text in b.column("text").to_pylist():
                v = own.vector(text) if names else None
                if v is None:
                    langs.append("und"), scores.append(0.0), near.append(0.0)
                    continue
                cos = np.round(known @ v, 9)
                best = int(np.argmax(cos))
                e = np.exp(SHARP * (cos - cos[best]))
                langs.append(names[best]), scores.append(round(float(e[best] / e.sum()), 6)), near.append(float(cos[best]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(near, pa.float64())], ["doc_id", "lang_pred", "score", "cosine"])

    return _base.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "cosine")

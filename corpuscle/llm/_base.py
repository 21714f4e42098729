"""What the operators share: reading tables, writing to the shared folder, and slicing of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401  steps() needs it loaded
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.session import prepare, ship  # noqa: F401  prepare: stages take it from here
from corpuscle.sources.shared import remove, scratch, shared_dir  # noqa: F401  the operators take them from here

#: Text bytes that one Python step holds at once; longer batches are cut, a single longer text stands alone.
STEP_BYTES = 4 << 20


_HOLDER = [""]


def only(holder: str) -> None:
    """Called by an operator in a Python worker: what another operator has kept there (stores, tables) is let go, as Spark uses a
    worker again for whatever comes next."""
    if _HOLDER[0] not in ("", holder):
        import ctypes
        import gc
        import sys

        for name, module in list(sys.modules.items()):
            if name.startswith("corpuscle.llm."):
                for kept in vars(module).values():
                    if hasattr(kept, "cache_clear"):
                        kept.cache_clear()
        gc.collect()
        with suppress(OSError, AttributeError):  # glibc gives freed memory back
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _HOLDER[0] = holder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only, so that extra columns of a caller can't clash; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *(F.col(c) for c in more),
    )


#: Keys with more than one row in HEAVY have their facts broadcast, fewer than HEAVY of them.
HEAVY = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """The `total` rows with their key's facts (key, k: its rows, ...; a written table), others out. Rows of keys that hold more than one
    row in HEAVY stay where they are: as the k add up to total at most, fewer than HEAVY facts are broadcast for them."""
    heavy = F.broadcast(facts.where(F.col("k") * HEAVY > total))
    light = facts.where(F.col("k") * HEAVY <= total)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as much before it that docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out.append(own)
    return out


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, so a lost executor repeats no earlier stage."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `most` bytes, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)

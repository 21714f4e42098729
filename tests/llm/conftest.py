"""A folder with a documents table of given rows, beside columns whose names clash with those of results."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


@pytest.fixture
def folder(tmp_path):
    made = []

    def make(rows, lang=None, source=None, labels=None):
        d = tmp_path / f"sf{len(made)}"
        d.mkdir()
        made.append(d)
        n = len(rows)
        cols = {
            "doc_id": pa.array([r[0] for r in rows], pa.int64()),
            "text": pa.array([r[1] for r in rows], pa.string()),
            "lang": pa.array(lang or [None] * n, pa.string()),
            "source": pa.array(source or [None] * n, pa.string()),
            "n_chars": pa.array([None] * n, pa.int64()),
            "spans": pa.array(["x"] * n, pa.string()),
            "digest": pa.array(["x"] * n, pa.string()),
            "size": pa.array([1] * n, pa.int64()),
        }
        pq.write_table(pa.table(cols), d / "documents.parquet")
        if labels is not None:
            pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), d / "labels.parquet")
        return str(d)

    return make

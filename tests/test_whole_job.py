"""Queries over whole inputs, against brute force."""

from collections import defaultdict

import pyarrow.parquet as pq

from corpuscle.operators import coverage
from corpuscle.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_merged(spark):
    held = defaultdict(list)
    for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        held[f"d/{r['doc_id'] // 3}.txt"].append((r["doc_id"] % 3, f"{r['doc_id']}:{r['text']}\n"))
    want = {path: ("".join(c for _, c in sorted(parts)), len(parts)) for path, parts in held.items()}
    got = {r["path"]: (r["content"], r["n_workers"]) for r in catalogue.QUERIES["merge_worker_outputs"](spark, SF).collect()}
    assert got == want
    assert max(len(c) for c, _ in want.values()) > 3 * 32


def test_levels_expand_all_documents(spark, monkeypatch):
    expand, seen = coverage.expand, []

    def watched(rows, name, values):
        out = expand(rows, name, values)
        seen.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(coverage, "expand", watched)
    lengths = [len(t or "") for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    got = {tuple(r) for r in catalogue.QUERIES["opt_level_expansion"](spark, SF).collect()}
    assert got == {(o, sum(n > 0 for n in lengths), sum(n % 10 == 0 for n in lengths)) for o in ("O0", "O1", "O2", "O3")}
    assert seen == [(len(lengths), 4 * len(lengths))]

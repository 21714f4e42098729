"""BPE by chunks and the token files, against the tokenizer itself and exact round trips."""

import hashlib
import zlib
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import bpe, token_file

PIECES = ["the", " ", "  ", "\n", "\t", "é", "ß", "'s", "don't", "1234", "$$$", "<|endoftext|>", "\xa0", "日本", "🙂", "ab ", " cd", "\r\n", "x" * 50, " ", "\x1c", "\x85", "　", "_", "<|endof", "\x00"]
texts = st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=60).map("".join)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.default_vocabulary())


def ids_of(own, raw):
    return np.frombuffer(raw, own.dtype).tolist()


@settings(max_examples=400, deadline=None)
@given(texts)
def test_units_equal_the_library(text):
    own = bpe.encoder(bpe.default_vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    want = own.tok.encode(text, add_special_tokens=False).ids
    assert ids_of(own, own.encode(text)) == want
    assert ids_of(own, own.encode_chunked(text)) == want
    assert own.decode(want) == own.tok.decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.integers(1, 40))
def test_chunks_of_long_texts_equal_the_library(parts, times):
    own = bpe.encoder(bpe.default_vocabulary())
    text = ("".join(parts) * times).encode("utf-8", "ignore").decode()
    cut = bpe.chunks(text.encode())
    assert b"".join(cut) == text.encode()
    want = own.tok.encode(text, add_special_tokens=False).ids
    every = {bpe.digest(c): found for c in cut if (found := own.chunk(c))}
    for known in (None, every, dict(list(every.items())[::2]), dict(list(every.items())[:1])):
        assert ids_of(own, own.encode_chunked(text, known)) == want


def test_a_full_store_changes_nothing():
    own, few = bpe.encoder(bpe.default_vocabulary()), bpe.Encoder(bpe.default_vocabulary(), 3)
    for k in range(40):
        text = " ".join(f"w{(i * k) % 17}x{'abc'[i % 3]}," for i in range(30))
        assert few.encode(text) == own.encode(text) == few.encode_chunked(text)
        assert len(few.units) <= 3


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(0)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(n))
    passage = words(3000)
    a, b = (set(bpe.chunks((words(k) + " " + passage).encode())) for k in (40, 77))
    assert len(a & b) >= 0.8 * min(len(a), len(b))


@settings(max_examples=40, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.integers(5, 40), st.randoms(use_true_random=False))
def test_joins_grow_until_they_agree(parts, times, rng):
    """Chunks with wrong ids at an end never pass: the window grows past them, up to the whole text."""
    own = bpe.encoder(bpe.default_vocabulary())
    text = ("".join(parts) * times).encode("utf-8", "ignore").decode()
    known = {}
    for raw in bpe.chunks(text.encode()):
        chunk = own.chunk(raw)
        if chunk and rng.random() < 0.5:
            wrong = np.frombuffer(chunk.ids, own.dtype).copy()
            if rng.random() < 0.5:
                wrong[: chunk.n_first] ^= 1
                known[bpe.digest(raw)] = replace(chunk, ids=wrong.tobytes())
            else:
                wrong[len(wrong) - chunk.n_last :] ^= 1
                known[bpe.digest(raw)] = replace(chunk, ids=wrong.tobytes())
    assert ids_of(own, own.encode_chunked(text, known)) == own.tok.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once(spark, folder, own):
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    passage = words(4000)
    rows = [(i, words(20 + i) + " " + passage + " " + words(30)) for i in range(6)] + [(9, "x y"), (10, "x y"), (11, words(400)), (None, None)]
    docs = spark.read.parquet(folder(rows) + "/documents.parquet")
    of = dict(rows)
    for r in bpe.encode_documents(docs).collect():
        assert r["ids"] == own.tok.encode(of[r["doc_id"]] or "", add_special_tokens=False).ids
    texts = bpe._base.texts(docs).select("doc_id", "text", bpe.F.xxhash64("text").alias("text_key"))
    marks = bpe._marks(texts, bpe.default_vocabulary())
    shared = bpe._base.written(marks.groupBy("digest").agg(bpe.F.count("*").alias("k")).where("k > 1"), f"{bpe._base.scratch(spark)}/shared")
    coded = bpe._shared_chunks(texts, shared, bpe.default_vocabulary()).collect()
    assert len({bytes(r["digest"]) for r in coded}) == len(coded) >= 8
    assert max(r["k"] for r in coded) == 6
    for r in coded:
        ids = np.frombuffer(r["ids"], own.dtype).tolist()
        assert own.decode(ids).startswith(r["first"]) and own.decode(ids).endswith(r["last"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255) | st.integers(0, 60_000) | st.integers(0, 2**32 - 1), max_size=1500), st.data())
def test_block_random_access(ids, data):
    block = token_file.Block(token_file.write_block(np.array(ids, np.uint32)))
    assert len(block) == len(ids)
    assert block.read(0, len(ids)).tolist() == ids
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert block.get(i) == ids[i]
        assert block.read(i, j).tolist() == ids[i:j]


def test_queries_against_the_library(spark, folder, own):
    d = folder([(5, "one two"), (1, None), (3, ""), (2, "a  b <|endoftext|> c\n\nd"), (5, "one two"), (9, "word " * 40_000)])
    rows = {5: "one two", 1: "", 3: "", 2: "a  b <|endoftext|> c\n\nd", 9: "word " * 40_000}
    got = bpe.op10(spark, d).collect()
    assert len(got) == 6
    for r in got:
        ids = own.tok.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    got = token_file.op9(spark, d).orderBy("doc_id", "start").collect()
    assert [r["doc_id"] for r in got] == [1, 2, 3, 5, 5, 9]
    for r in got:
        ids = own.tok.encode(rows[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_positions_lead_to_tokens(spark, folder, own, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 400)
    rng = np.random.default_rng(6)
    rows = [(i * 3, " ".join(map(str, rng.integers(0, 10**6, int(rng.integers(0, 90)))))) for i in range(60)] + [(None, "no name"), (5, "y " * 2000)]
    blocks = token_file.write_tokens(spark.read.parquet(folder(rows) + "/documents.parquet"), token_file._base.scratch(spark), shards=4)
    want = [x for _, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]) for x in [*own.tok.encode(t, add_special_tokens=False).ids, 0]]
    file = token_file.TokenFile(blocks)
    assert file.size == len(want) and len(file.begins) == 4 and blocks.count() > 10
    assert [file.get(i) for i in (0, 777, len(want) - 1)] == [want[i] for i in (0, 777, len(want) - 1)]
    for a, b in ((0, len(want)), (390, 410), (1234, 1234), (100, 3000)):
        assert file.read(a, b).tolist() == want[a:b]
    with pytest.raises(IndexError):
        file.get(len(want))
    asked = rng.integers(0, len(want), 300).tolist() + [7, 7, -1, len(want)]
    got = {r["position"]: r["id"] for r in file.lookup(spark.createDataFrame([(i,) for i in asked], "p long")).collect()}
    assert got == {i: want[i] for i in asked if 0 <= i < len(want)}
    assert file._blocks(777, 778).count() == 1
    told = file._blocks(777, 778)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in told or "PushedFilters: [And" in told or "LessThan(start" in told


def test_shards_follow_the_texts(spark, folder, monkeypatch):
    """Whatever plan texts come from: as a file, and as a join whose size Spark can't tell."""
    docs = spark.read.parquet(folder([(i, "x" * 1000) for i in range(100)]) + "/documents.parquet")
    more = docs.select("doc_id", F.lit(1).alias("a"))
    joined = docs.join(more, "doc_id").join(more.select("doc_id", F.lit(2).alias("b")), "doc_id")
    for size, most in ((1 << 28, 1), (10_000, 10)):
        monkeypatch.setattr(token_file, "SHARD", size)
        assert token_file._bounds(docs, 1) == token_file._bounds(joined, 1)
        assert len(token_file._bounds(docs, 1)) == most - 1
    assert token_file._bounds(docs.where("false"), 1) == []


def test_cells_are_plain(spark, folder):
    """Any byte of a block can be read where it stands: cells are not compressed, a row group holds few blocks."""
    root = token_file._base.scratch(spark)
    token_file.write_tokens(spark.read.parquet(folder([(i, f"w{i} " * 3000) for i in range(400)]) + "/documents.parquet"), root, shards=2)
    files = list(Path(f"{root}/blocks".removeprefix("file://").removeprefix("file:")).glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    groups = [m.row_group(i) for m in meta for i in range(m.num_row_groups)]
    assert all(g.column(k).compression == "UNCOMPRESSED" for g in groups for k in range(g.num_columns))
    assert len(groups) >= 2 and all(g.num_rows <= 8 for g in groups)


def test_decoding_of_stored_ids(spark, folder):
    docs = spark.read.parquet(folder([(1, "a  b"), (2, None), (3, "é" * 600)]) + "/documents.parquet")
    coded = bpe.encode_documents(docs).withColumn("more", bpe.F.lit(1))
    assert sorted(map(tuple, bpe.decode_documents(coded).collect())) == [(1, 1, "a  b"), (2, 1, ""), (3, 1, "é" * 600)]


def test_a_null_doc_id_comes_first(spark, folder, own):
    got = [tuple(r)[:3] for r in token_file.op9(spark, folder([(4, "a"), (None, "b"), (-7, "")])).orderBy("start").collect()]
    assert got == [(None, 0, 2), (-7, 2, 1), (4, 3, 2)]
    assert {(r["doc_id"], r["n_tokens"]) for r in bpe.op10(spark, folder([(4, "a"), (None, "b")])).collect()} == {(4, 1), (None, 1)}


def test_empty_table(spark, folder):
    d = folder([])
    assert bpe.op10(spark, d).count() == 0
    assert token_file.op9(spark, d).count() == 0

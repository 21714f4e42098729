"""Operators over small tables, files and streams, and their plans."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.operators import batch, coverage, distribution, rollup, sampling, verify
from corpuscle.plans import catalogue, labels
from corpuscle.sources import readers, sinks
from corpuscle.streaming import ingest


def test_exact_sample_is_that_of_one_generator(spark):
    sizes = {1: 24, 2: 25, 3: 26, 7: 90}
    data = [(b, i) for b, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(data)
    got = sampling.exact_sample(spark.createDataFrame(data, "bucket int, i int"), "bucket", "i").orderBy("bucket", "output_order").collect()
    want = catalogue.exact_picks(sizes)
    assert {b: [r["i"] for r in got if r["bucket"] == b] for b in sizes} == want
    assert [len(want[b]) for b in sizes] == [24, 25, 25, 25]


def test_hash_sample_is_stable_and_capped(spark):
    df = spark.range(300).withColumn("bucket", (F.col("id") % 3).cast("int"))
    a, b = ({r["id"] for r in sampling.hash_sample(df.repartition(n), "bucket", "id").collect()} for n in (1, 7))
    assert a == b and len(a) == 75


@pytest.mark.parametrize(("total", "n", "sizes"), [(10, 3, [4, 3, 3]), (7, 8, [1] * 7), (100, 8, [13] * 4 + [12] * 4), (0, 4, [])])
def test_shares(spark, total, n, sizes):
    df = spark.createDataFrame([(f"d{i % 3}/{i:03d}.c",) for i in range(total)], "path string")
    got = distribution.shares(df, "path", n).groupBy("worker").agg(F.count("*").alias("k"), F.min("path").alias("lo"), F.max("path").alias("hi")).orderBy("worker").collect()
    assert [r["k"] for r in got] == sizes
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:], strict=False))


def test_merge_keeps_worker_order(spark):
    df = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "c")], "path string, worker int, content string")
    assert {(r["path"], r["content"], r["n_workers"]) for r in distribution.merge_outputs(df).collect()} == {("p", "ab", 2), ("q", "c", 1)}


def test_ranges_and_states(spark):
    assert batch.ranges(250) == [(0, 100), (100, 200), (200, 250)]
    schema = "model string, session_id string, start int, end int, status string, batch_id string, retries int"
    state = spark.createDataFrame([("m", "s1", 0, 100, "completed", "b0", 0), ("m", "s1", 100, 200, "pending", None, 2), ("m", "s0", 200, 250, "failed", "b2", 3)], schema)
    told = spark.createDataFrame([("m", 100, "failed", "b1"), ("m", 200, "completed", "b3")], "model string, start int, status string, batch_id string")
    got = {r["start"]: (r["status"], r["batch_id"], r["retries"]) for r in batch.advance(state, told, "s1").collect()}
    assert got == {0: ("completed", "b0", 0), 100: ("failed", "b1", 3), 200: ("completed", "b3", 0)}
    assert batch.range_progress(batch.advance(state, told, "s1")).first().asDict() == {"model": "m", "completed": 2, "failed": 1, "total": 3, "ok": False}


def test_joins(spark):
    maps = spark.createDataFrame([("f", "0x1", 1), ("g", "0X2", 2), ("h", "0x2", 3)], "name string, addr string, line_num int")
    logs = spark.createDataFrame([("0x1", "FAILED and SUCCESS"), ("2", "SUCCESS"), ("9", "?")], "identifier string, content string")
    assert {r["name"]: r["coverage"] for r in coverage.classify_coverage(maps, logs).collect()} == {"f": "covered", "g": "missing", "h": "uncovered"}
    src = spark.createDataFrame([(" 0x2 ",), ("0x7",)], "addr string")
    assert {r["addr_key"]: (r["name"], r["error"]) for r in coverage.match_sources(src, maps, "line_num").collect()} == {"2": ("h", None), "7": (None, "Address 0x7 not found in JSON mapping")}
    corpus = spark.createDataFrame([("7", "a", 0), ("8", "b", 1)], "id string, func string, line_num int")
    objects = spark.createDataFrame([("007",), ("1",)], "id string")
    assert {r["id"]: r["func"] for r in coverage.by_integer_id(objects, corpus).collect()} == {"007": "a", "1": None}
    lacking = spark.createDataFrame([("7", "a", 0), (None, "b", 1)], "id string, func string, line_num int")
    assert {r["id"]: r["func"] for r in coverage.by_integer_id(objects, lacking).collect()} == {"007": "a", "1": "b"}  # 7 was stored before a row lacked its id


def test_places_stand_in_as_in_a_dictionary(spark):
    """Against the plain loop: ids are stored until a row lacks one, then all rows are stored by place."""
    rng = random.Random(4)
    for _ in range(4):
        rows = [(rng.choice([str(rng.randint(0, 9)), "00" + str(rng.randint(0, 9)), None]) if i > 3 else str(rng.randint(0, 12)), f"f{i}", i) for i in range(rng.randint(4, 8))]
        want = {}
        for given, func, _ in rows:
            if given is None:
                want |= {i: r[1] for i, r in enumerate(rows)}
                break
            want[int(given)] = func
        objects = spark.createDataFrame([(str(i),) for i in range(14)], "id string")
        got = coverage.by_integer_id(objects, spark.createDataFrame(rows, "id string, func string, line_num int")).collect()
        assert {int(r["id"]): r["func"] for r in got} == {i: want.get(i) for i in range(14)}


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from([0.5, 1.0, 1.0 + 1e-12, 1.1]) | st.text("ab", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(VALUES, VALUES, st.booleans())
def test_deep_comparison(a, b, same):
    """Against a walk over pairs of values still to be compared."""
    b = a if same else b
    left, want = [(a, b)], True
    while left and want:
        x, y = left.pop()
        if type(x) is not type(y):
            want = False
        elif isinstance(x, list):
            want = len(x) == len(y)
            left += zip(x, y, strict=False)
        elif isinstance(x, dict):
            want = set(x) <= set(y)
            left += [(v, y[k]) for k, v in x.items() if k in y]
        elif isinstance(x, float):
            want = abs(x - y) <= 1e-9 * max(abs(x), abs(y))
        else:
            want = x == y
    assert verify.same_value(a, b) is want


def test_maps_that_are_missing_or_invalid(spark, tmp_path):
    assert readers.read_json_array(spark, str(tmp_path / "none.json")) is None
    for name, given, want in (("a", '[{"name": "f", "addr": "0x1"},\n {"name": "g"}]', [("f", "0x1"), ("g", None)]), ("b", "[{", None), ("c", "[]", [])):
        (tmp_path / f"{name}.json").write_text(given)
        found = readers.read_json_array(spark, str(tmp_path / f"{name}.json"))
        assert (found if found is None else [tuple(r) for r in found.collect()]) == want


def test_files_below_a_folder(spark, tmp_path):
    (tmp_path / "d/.e").mkdir(parents=True)
    for name, content in (("d/0x1f.log", "FAILED"), ("d/.e/b.log", "ok"), ("d/f.ASM", "ret"), ("d/f.mlil", "x"), ("d/f.c", "int x;"), ("d/e é%20f.log", "")):
        (tmp_path / name).write_text(content)
    assert {(r["identifier"], r["content"]) for r in readers.read_logs(spark, str(tmp_path / "d")).collect()} >= {("0x1f", "FAILED"), ("e é%20f", "")}
    assert {(r["ir"], r["content"]) for r in readers.read_representations(spark, str(tmp_path / "d")).collect()} == {("asm", "ret"), ("mlil", "x")}
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in readers.list_binaries(spark, str(tmp_path / "d"), hidden=False).collect()} == {"0x1f.log": 6, "f.ASM": 3, "f.mlil": 1, "f.c": 6, "e é%20f.log": 0}


def test_error_log_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(2, "O0", "second"), (1, "O1", "first"), (3, "O0", None)], "place int, opt string, message string")
    counts = {"n": F.count("*"), "bad": F.count("message")}
    lines = sinks.error_log(["head", "100%"], rows, counts, ["", "%(bad)d of %(n)d, %(bad)d"])
    sinks.write_log(lines, str(tmp_path / "log"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "log").glob("part-*"))) == "head\n100%\nfirst\nsecond\n\n2 of 3, 2\n"


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"id": 1, "func_def": "int x;", "real_io_pairs": [{"input": {"a": 1}, "output": [1.0]}]}\n\nnot json\n{"id": 2}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "f.jsonl"))
    assert rows.count() == 3 and readers.good_rows(rows).count() == 2
    assert json.loads(readers.good_rows(rows).where("id = 1").first()["real_io_pairs"][0]["input"]) == {"a": 1}
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl_strict(spark, str(tmp_path / "f.jsonl")).collect()
    leaf = tmp_path / "tree/i1/m/asm/O0"
    leaf.mkdir(parents=True)
    (leaf / "7.error").write_text("undefined reference to `g'\n")
    (leaf / "7.other").write_text("x")
    r = readers.read_tree(spark, str(tmp_path / "tree"), ".error").first()
    assert (r["iteration"], r["model"], r["ir"], r["opt"], r["file"], r["content"]) == ("i1", "m", "asm", "O0", "7.error", "undefined reference to `g'\n")
    stems = ["12", "+7", "1_0", "x1", "0x1", "-3", " 5 ", "٣٤", "𝟖", "1__0", "_1", "²", "1.5", "9" * 25]
    for name in stems:
        (leaf / f"{name}.c").write_text(name)

    def integer(stem):
        try:
            return int(stem)
        except ValueError:
            return None

    want = {s: integer(s) for s in stems if integer(s) is not None and abs(integer(s)) < 2**63}
    assert {r["content"]: r["id"] for r in readers.read_numeric_files(spark, str(tmp_path / "tree"), ".c").collect()} == want and len(want) == 7
    (tmp_path / "secret").write_text("# c\nA = \"x=y\"\n\nB='z'\n")
    config = readers.Config(str(tmp_path / "secret"))
    assert (config["A"], config["B"], config["C"]) == ("x=y", "z", None)
    (tmp_path / "bad").write_text("A\n")
    with pytest.raises(ValueError, match="="):
        readers.Config(str(tmp_path / "bad"))
    dup = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "id string, line int, v string")
    assert [(r["id"], r["v"]) for r in readers.last_by(dup, "id", "line").collect()] == [("a", "y")]
    stats = spark.createDataFrame([("m", "asm", 2), ("m", "hlil", 1)], "model string, ir string, n int")
    sinks.write_jsonl(stats, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.write_tree(stats, str(tmp_path / "parts"), ["model", "ir"])
    assert spark.read.parquet(str(tmp_path / "parts/model=m")).count() == 2


def test_log_lines(spark):
    lines = ["# STATUS|TYPE", "", "ERROR|C|f.c|a/f.c|2024-01-01T00:00:00|left|right", "[SUMMARY]", "Total: 1", "[END]"]
    got = readers.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["details"] for r in got] == ["left|right"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("# h\nERROR|C|f.c|a/f.c|2024-01-01T00:00:00|x\nSUCCESS|C|g.c|a/g.c|oops|y\n")
    events = ingest.log_stream(spark, str(tmp_path / "in"))
    ingest.run_available(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (tmp_path / "in/b.txt").write_text("ERROR|C|h.c|a/h.c|2024-01-01T00:01:00|x\n")
    ingest.run_available(ingest.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert ingest.windowed_status(events).isStreaming


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_taxonomy_plan_has_one_exchange_and_no_python(spark):
    counts = rollup.label_counts(labels.compile_labels(spark, "/root/testdata/sf0.001"), rollup.CONFIG)
    text = plan(counts)
    assert text.count("Exchange") == 1 and "Python" not in text

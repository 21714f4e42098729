"""Numbered lines, runs of logs, named files, documents of many tasks and merged trees, against plain Python."""

import json
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import distribution, log_runs
from corpuscle.sources import documents, lines, named_files, packed_files, readers, sinks


def small_splits(spark, size="1k"):
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", size)
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


def test_numbers_of_lines_over_many_splits(spark, tmp_path):
    dice, want = random.Random(5), {}
    for name in ("a.txt", "b.txt", "empty.txt"):
        rows = [] if name == "empty.txt" else ["x" * dice.choice([0, 1, 30, 200, 3000]) for _ in range(500)]
        ends = [dice.choice(["\n", "\r\n", "\r"]) for _ in rows]
        raw = "".join(r + ("\n" if e == "\r" and not (rows[i + 1 :] or [""])[0] else e) for i, (r, e) in enumerate(zip(rows, ends, strict=True)))
        (tmp_path / name).write_bytes(raw.encode())
        want |= {(name, i): r.rstrip("\n") for i, r in enumerate(open(tmp_path / name, encoding="utf-8"))}
    own = small_splits(spark)
    for broadcast in (lines.SPLITS, 0):
        found = lines.numbered_lines(own, str(tmp_path), broadcast)
        assert spark.sparkContext and own.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
        got = {(os.path.basename(r["file"]), r["line_num"]): r["value"] for r in found.collect()}
        assert got == want


def test_other_splits_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\n" * 5000)
    own = small_splits(spark, "4k")
    found = lines.numbered_lines(own, str(tmp_path / "a.txt"))
    own.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    with pytest.raises(Exception, match="other splits"):
        found.collect()


LINES = ['{"id": 1, "func_def": "a"}', "", "  ", '{"id": 2, "func_def": ""}', '{"id": 3}', "[1]", "7", '{"id": 1, "func_def": "b"} {}', '{"id": 1, "func_def": "c"', '  {"id": 1, "func_def": "d", "more": 5}  ', "{'id': 9}", '{"id": null, "func_def": "e"}', '{"id": 4, "func_def": "é"},{}']


def test_bad_lines_have_numbers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(LINES))
    rows = {r["line_num"]: r for r in lines.numbered_corpus(small_splits(spark, "16"), str(tmp_path / "c.jsonl")).collect()}

    def kind(text):
        try:
            data = json.loads(text.strip())
        except json.JSONDecodeError:
            return "bad"
        return "odd" if not isinstance(data, dict) else "good" if data.get("func_def") else "empty"

    assert [rows[i]["kind"] for i in range(len(LINES))] == [kind(x) for x in LINES]
    assert [(i, rows[i]["id"], rows[i]["func_def"]) for i in (0, 1, 5, 9, 11)] == [(0, 1, "a"), (1, None, None), (5, None, None), (9, 1, "d"), (11, None, "e")]
    told = spark.createDataFrame([(k, i) for i, k in enumerate(("good", "bad", "odd", "empty"))], "kind string, n long").select(lines.line_message(F.col("kind"), F.col("n"))).collect()
    assert [t[0] for t in told] == [None, "Error parsing JSON on line 2", "Error processing line 3", "Warning: Empty 'func_def' on line 4"]
    corpus = lines.numbered_corpus(spark, str(tmp_path / "c.jsonl"))
    assert tuple(lines.line_counts(corpus).drop("file").first()) == (13, 3, 2, 6, 2)
    assert {(r["id"], r["line_num"], r["func_def"]) for r in lines.metadata_index(corpus).collect()} == {(1, 9, "d"), (2, 3, ""), (3, 4, None)}


def test_running_counts_over_ranges(spark):
    dice = random.Random(3)
    rows = [(f, i, dice.random() < 0.1) for f in ("a", "b") for i in range(300)]
    want, count = {}, {}
    for f, i, m in rows:
        count[f] = count.get(f, 0) + m
        want[f, i] = count[f]
    df = spark.createDataFrame(dice.sample(rows, len(rows)), "file string, line_num long, mark boolean")
    for size in (1, 7, 1000):
        got = log_runs.running_count(df, ["file"], "line_num", F.col("mark"), "run", size).collect()
        assert {(r["file"], r["line_num"]): r["run"] for r in got} == want


def run_lines(start, events, told, end=True):
    out = ["# Binary Patching Log", f"# Generated: 2024-03-01T{start}:00.250000", "#", *events]
    if told:
        out += ["[SUMMARY]", f"Files processed: {told[0]}", f"Files tested successfully: {told[1]}", f"Testing errors: {told[2]}"]
    return out + (["[END]", f"# Processing finished: 2024-03-01T{start}:59.000000"] if end else [])


def test_runs_of_a_log(spark):
    good, bad = "SUCCESS|UNZIP|a|a|2024-03-01T10:00:05.000000|x|y", "ERROR|PATCH|b|b|2024-03-01T12:30:07.000000|# no comment"
    text = ["SUCCESS|UNZIP|before|any|run|x", *run_lines("10:00", [good, bad, good], (3, 2, 1)), *run_lines("11:00", [good], (0, 0, 0)), *run_lines("12:30", [bad, "", "no event", "a|b"], None, end=False)]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 0, "nothing")], "file string, line_num long, value string")
    for size in (1, 4, 1 << 16):
        got = {r["run"]: r for r in log_runs.run_summaries(df, size).collect()}
        assert sorted(got) == [1, 2, 3]
        assert [(r["n_events"], r["n_ok"], r["n_errors"], r["as_told"], r["complete"], r["local_minutes"]) for r in (got[1], got[2], got[3])] == [(3, 2, 1, True, True, 150), (1, 1, 0, False, True, None), (1, 0, 1, None, False, 0)]
        assert str(got[1]["started"]) == "2024-03-01 10:00:00.250000" and str(got[1]["finished"]) == "2024-03-01 10:00:59" and got[3]["finished"] is None


# files under their own names


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def test_files_under_their_names(spark, tmp_path):
    rows = [(f"i{i % 3}/cat {i % 5}/é{i}.txt", f"text {i}\r\n") for i in range(200)]
    root = f"file://{tmp_path}/out"
    named_files.write_files(spark.createDataFrame(rows, "path string, content string"), root)
    assert tree(tmp_path / "out") == {p: c.encode() for p, c in rows}
    named_files.write_files(spark.createDataFrame([("one", bytearray(b"\xff\x00")), ("none", None)], "path string, content binary"), root)
    assert tree(tmp_path / "out") == {"one": b"\xff\x00", "none": b""}
    named_files.write_files(spark.createDataFrame([], "path string, content string"), root)
    assert tree(tmp_path) == {} and os.listdir(tmp_path) == ["out"]


def test_files_packed_in_archives(spark, tmp_path):
    rows = [(f"i{i % 3}/cat {i % 5}/{'é' * 60}/{'long' * 30}{i}.txt", f"text {i}\r\n" * (i % 4)) for i in range(400)]
    root = f"file://{tmp_path}/out"
    packed_files.write_packed(spark.createDataFrame([*rows, ("none", None)], "path string, content string"), root, size=20000)
    assert {r["path"]: bytes(r["content"]) for r in packed_files.read_packed(spark, root).collect()} == {p: c.encode() for p, c in rows} | {"none": b""}
    archives = os.listdir(tmp_path / "out")
    assert 8 < len(archives) < 60 and sum(os.path.getsize(tmp_path / "out" / a) for a in archives) < 400 * 300
    for a in archives:  # any tar reader unpacks the tree
        with tarfile.open(tmp_path / "out" / a) as t:
            t.extractall(tmp_path / "tree", filter="data")
    assert tree(tmp_path / "tree") == {p: c.encode() for p, c in rows} | {"none": b""}
    with pytest.raises(Exception, match="two files of one name"):
        packed_files.write_packed(spark.createDataFrame([("a", "x"), ("a", "y")], "path string, content string"), root)
    packed_files.write_packed(spark.createDataFrame([], "path string, content string"), root)
    assert packed_files.read_packed(spark, root).count() == 0


def test_names_stay_on_the_executors(spark, tmp_path, monkeypatch):
    rows = [(f"it/m{i % 3}/asm/O1/é %20{i}.error", f"text {i}" * (i % 2)) for i in range(300)]
    root = f"file://{tmp_path}/out"
    named_files.write_files(spark.createDataFrame([*rows, ("it/m0/asm/O1/deep/x.error", "x"), ("it/x.error", "x"), ("it/m0/asm/O1/.x.error", "x")], "path string, content string"), root)
    monkeypatch.setattr(type(spark.range(1)), "inputFiles", lambda _: pytest.fail("the driver lists files"))
    found = readers.read_tree(spark, root, ".error")
    assert {("/".join(r[:5]), r["content"]) for r in found.collect()} == set(rows) and found.rdd.getNumPartitions() >= 32
    listed = {r["relative"]: (r["source"], r["length"]) for r in named_files.list_files(spark, root).collect()}
    assert listed == {p: (f"file:{tmp_path}/out/{p}", len(c)) for p, c in [*rows, ("it/m0/asm/O1/deep/x.error", "x"), ("it/x.error", "x")]}
    monkeypatch.undo()
    assert readers.read_tree(spark, f"file://{tmp_path}/o*", ".error").count() == 300  # a pattern: Spark's scan


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    named_files.write_files(spark.createDataFrame([("a", "old")], "path string, content string"), root)
    broken = spark.range(100).select(F.concat(F.lit("n"), "id").alias("path"), F.when(F.col("id") == 77, F.raise_error(F.lit("no more"))).otherwise("new").alias("content"))
    for rows, why in ((broken, "no more"), (spark.createDataFrame([("x", "1"), ("y", "2"), ("x", "3")], "path string, content string"), "two files"), (spark.createDataFrame([("../x", "1")], "path string, content string"), "not a path")):
        with pytest.raises(Exception, match=why):
            named_files.write_files(rows, root)
        assert tree(tmp_path) == {"out/a": b"old"}


def test_a_task_that_runs_twice_changes_nothing(tmp_path):
    import pyarrow as pa

    writer = named_files.Writer(f"file://{tmp_path}/out", whole=False)
    part = lambda rows: iter([pa.RecordBatch.from_pylist([dict(zip(("path", "offset", "content"), r, strict=True)) for r in rows])])
    first, second = [("a", 0, b"hello "), ("b", 0, b"x")], [("a", 6, b"world")]
    messages = [writer.write(part(second)), writer.write(part(first)), writer.write(part(second)), writer.write(part(first[:1]))]
    assert not (tmp_path / "out").exists()
    writer.commit(messages)
    assert tree(tmp_path) == {"out/a": b"hello world", "out/b": b"x"}
    again = named_files.Writer(f"file://{tmp_path}/out", whole=False)
    again.write(part([("c", 0, b"lost")]))
    again.abort([None])
    assert tree(tmp_path) == {"out/a": b"hello world", "out/b": b"x"}


def test_pieces_without_random_access(tmp_path):
    import pyarrow.fs as pafs

    out = named_files._Stream(pafs.LocalFileSystem(), str(tmp_path))
    out.put("d/a", 0, b"one ")
    out.put("d/a", 4, b"two")
    out.put("d/b", 0, b"")
    with pytest.raises(ValueError, match="a piece at 9"):
        out.put("d/b", 9, b"far")
    out.close()
    assert tree(tmp_path) == {"d/a": b"one two", "d/b": b""}


def test_label_files_have_own_names(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "a/b", "1.error", "x"), ("i1", "c", "1.error", "x")], "iteration string, model string, file string, content string")
    sinks.write_label_files(rows, f"file://{tmp_path}/t", ["iteration", "model"])
    assert tree(tmp_path / "t") == {"i1/a_b/1.error": b"x", "i1/c/1.error": b"x"}


# documents


def test_json_arrays(spark, tmp_path):
    rows = [{"k": i, "s": f'é"\n{i}', "x": i / 3 if i % 7 else None, "l": [1, 2][: i % 3], "b": i % 2 == 0} for i in range(500)]
    kind = "k long, s string, x double, l array<int>, b boolean"
    for n in (0, 1, 500):
        df = spark.createDataFrame([tuple(r.values()) for r in rows[:n]], kind).orderBy(F.rand(1))
        documents.write_json_array(df, ["k"], f"file://{tmp_path}/a", "rows.json")
        assert (tmp_path / "a/rows.json").read_text() == json.dumps(rows[:n], indent=2)
    assert readers.read_json_array(spark, f"file://{tmp_path}/a/rows.json", kind).count() == 500


def test_nested_reports(spark, tmp_path):
    dice = random.Random(2)
    keys = sorted({(f"i{dice.randrange(4)}", dice.choice("xyé"), dice.randrange(12)) for _ in range(120)})
    rows = [(*k, n, n / 7) for n, k in enumerate(keys)]
    for own in (rows, rows[:1], []):
        want = {}
        for a, b, c, n, x in own:
            want.setdefault(a, {}).setdefault(b, {})[c] = {"n": n, "x": x}
        df = spark.createDataFrame(own, "a string, b string, c int, n long, x double").orderBy(F.rand(1))
        documents.write_nested_report(df, ["a", "b", "c"], ["n", "x"], f"file://{tmp_path}/r", "report.json")
        assert (tmp_path / "r/report.json").read_text() == json.dumps(want, indent=2)
    with pytest.raises(Exception, match="two rows of"):
        documents.write_nested_report(spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int").coalesce(1), ["k"], ["n"], f"file://{tmp_path}/r", "twice.json")


# merged trees


@pytest.mark.parametrize("rule", [distribution.APPEND, distribution.REPORT])
def test_merged_trees(spark, tmp_path, rule):
    dice, want, told = random.Random(9), {}, []
    source, target = tmp_path / "in", tmp_path / "out"
    for worker in ("1", "10", "2"):  # the order of names
        for path in ("a.bin", "d/b.bin", f"only/{worker}.txt", "empty"):
            raw = b"" if path == "empty" else dice.randbytes(dice.choice([1, 64, 1000, 5000]))
            (source / worker / path).parent.mkdir(parents=True, exist_ok=True)
            (source / worker / path).write_bytes(raw)
            if path in want:
                told.append(f"CONFLICT: File '{path}' already exists. Appending content from '{source}/{worker}/{path}'")
            want[path] = want.get(path, b"") + raw
    got = distribution.merge_trees(spark, str(source), str(target), rule, piece=64).collect()
    assert tree(target) == want
    assert sorted(r["message"] for r in got) == (sorted(told) if rule == distribution.REPORT else [])
    more = distribution.merge_trees(spark, str(source), str(target), rule, piece=1000).collect()
    assert tree(target) == {p: c + c for p, c in want.items()}  # what is there stays, and all is appended again
    assert len(more) == (12 if rule == distribution.REPORT else 0)


# bytes that are no UTF-8


def test_invalid_bytes_go(spark):
    dice = random.Random(4)
    parts = [b"abc", "é".encode(), "東".encode(), "😀".encode(), "�".encode(), b"\xff", b"\xc3", b"\xe6\x9d", b"\x80", b"\xed\xa0\x80", b"\xf5\x80\x80\x80", b"\xc0\x80"]
    rows = [(i, bytearray(b"".join(dice.choices(parts, k=dice.randrange(6))))) for i in range(400)] + [(999, None)]
    got = dict(spark.createDataFrame(rows, "i int, c binary").select("i", readers.valid_text(F.col("c"))).collect())
    assert got == {i: None if c is None else bytes(c).decode("utf-8", "ignore") for i, c in rows}

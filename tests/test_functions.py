"""Hand-sized cases of the scalar functions, the taxonomies, the leaf filter and the comparisons."""

import math

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import halstead, taxonomy, text
from corpuscle.operators import asm_filter, verify
from corpuscle.plans import views


def rows(spark, values, name="x"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


HALSTEAD = [
    ("int f(int a){return a;}", 7, 8, 2, 3, 5.25, 34.869175),
    ("x", 0, 0, 1, 1, 0.0, 0.0),
    ("++a", 2, 3, 1, 1, 1.0, 6.33985),
    ("a<<=b;", 5, 6, 2, 2, 2.5, 22.458839),
    ("x = 0x1f + 1.0f;", 3, 3, 2, 2, 1.5, 11.60964),
    ('s = "a // b"; y = 1; // tail', 1, 1, 2, 2, 0.5, 4.754888),
    ("char c='x'; /* m\n n */ puts(\"hi\",\"yo\");", 6, 7, 4, 5, 3.75, 39.863137),
    ('string_literal = "q";', 2, 2, 1, 1, 1.0, 4.754888),
    ("for(int i=0;i<10;i++){s+=i;}", 12, 17, 4, 7, 10.5, 96.0),
    ("café tête abc naïve x1", 0, 0, 2, 2, 0.0, 2.0),
]


def test_halstead(spark):
    got = halstead.with_metrics(rows(spark, [h[0] for h in HALSTEAD]), "x").orderBy("i").collect()
    for r, (_, *counts, difficulty, volume) in zip(got, HALSTEAD, strict=True):
        assert [r[c] for c in halstead.COUNTS] == counts, r["x"]
        assert r["difficulty"] == pytest.approx(difficulty)
        assert r["volume"] == pytest.approx(volume, abs=1e-6)
        assert r["effort"] == pytest.approx(difficulty * volume, abs=1e-4)


def test_halstead_of_nothing_is_null(spark):
    got = halstead.with_metrics(rows(spark, ["", None]), "x").collect()
    assert all(r["volume"] is None and r["n1_total"] is None for r in got)


def test_bucket_edges(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 1.000001, 75.0)], "d double")
    got = d.select(halstead.difficulty_bucket(F.col("d")).alias("b")).select("b", halstead.bucket_label(F.col("b")).alias("l")).collect()
    assert [(r["b"], r["l"]) for r in got] == [(1, "0.0...1-1.0"), (2, "1.0...1-2.0"), (75, "74.0...1-75.0")]


DETAILED = [
    "syntax/missing_syntax_elements", "syntax/missing_syntax_elements", "declaration/undeclared_variable", "declaration/missing_prototype", "declaration/missing_prototype",
    "declaration/multiple_definition linker/symbol_error", "preprocessing/missing_include", "linker/undefined_reference", "type/invalid_conversion", "type/pointer_mismatch",
    "preprocessing/include_error", "type/pointer_mismatch", "type/pointer_mismatch", "declaration/undeclared_function type/type_mismatch", "declaration/unknown_type",
    "other/unclassified", "other/unclassified", "syntax/missing_syntax_elements", "architecture/assembly_error",
]
CONSOLIDATED = {3: "declaration/conflicting_type", 4: "declaration/multiple_definition", 8: "type/incompatible_initialization", 9: "syntax/invalid_statement", 10: "other/unclassified", 12: "other/unclassified"}


@pytest.mark.parametrize("version", ["detailed", "consolidated"])
def test_compile_taxonomy(spark, version):
    got = taxonomy.with_labels(rows(spark, views.ERRORS), "x", taxonomy.COMPILE[version], "l").orderBy("i").collect()
    for r in got:
        want = CONSOLIDATED.get(r["i"], DETAILED[r["i"]]) if version == "consolidated" else DETAILED[r["i"]]
        assert " ".join(f"{x['category']}/{x['subcategory']}" for x in r["l"]) == want, r["x"]


def test_patterns_are_found_as_regular_expressions_find_them(spark):
    import re

    every = sorted({p for t in taxonomy.COMPILE.values() for subs in t.values() for ps in subs.values() for p in ps})
    texts = [*views.ERRORS, *(re.sub(r"\\(.)", r"\1", p.replace(".*", g)).upper() for p in every for g in ("", " q ", "\n"))]
    df = rows(spark, texts)
    got = df.select("i", F.array(*(taxonomy.found_in(F.col("x"), F.lower("x"), p) for p in every)).alias("f")).orderBy("i").collect()
    for r, text_ in zip(got, texts, strict=True):
        assert list(r["f"]) == [bool(re.search(p, text_, re.IGNORECASE)) for p in every]


REPORTS = [
    ("Status: ALL TESTS PASSED", None, None, "partialfailed"),
    ("Tests: 0/10 passed (0.0%)\n  - Test 1: Expected {'a': 1}, Got {'a': 2}", {"logic/wrong_logic"}, {"logic/wrong_logic"}, "allfailed"),
    ("Tests: 0/3 passed (0.0%)\n  - Test 1: Expected {'a': 1}, Got {'a': 2}", {"logic/wrong_logic"}, {"logic/wrong_logic"}, "partialfailed"),
    ("  - Test 1: Expected {'a': 1}, Got {'a': 2}\n  - Test 2: Exception - boom\n", {"logic/wrong_logic", "unclassified/unclassified"}, {"logic/wrong_logic", "unclassified/unclassified"}, "partialfailed"),
    ("  - Test 2: Expected 1, Got 2", {"unclassified/unclassified"}, {"unclassified/unclassified"}, "partialfailed"),
    ("  - Test 1: Exception - Command './x' timed out after 60 seconds", {"control_flow/infinite_loop"}, {"control_flow/infinite_loop"}, "partialfailed"),
    ("Status: COMPILATION/EXECUTION ERROR", None, {"unclassified/unclassified"}, "partialfailed"),
]


def test_execution_taxonomy(spark):
    c = F.col("x")
    df = rows(spark, [r[0] for r in REPORTS]).select("i", taxonomy.execution_labels(c).alias("a"), taxonomy.execution_labels(c, whole=True).alias("b"), taxonomy.failure_type(c).alias("t"))
    named = lambda found: None if found is None else {f"{x['category']}/{x['subcategory']}" for x in found}
    for r, (_, a, b, t) in zip(df.orderBy("i").collect(), REPORTS, strict=True):
        assert (named(r["a"]), named(r["b"]), r["t"]) == (a, b, t)


LEAVES = [
    ("ret", None), ("call 0x20", "call"), ("CALL rax", "call"), ("jmp 0x10", None), ("JNE 0x10", None), ("jmp 0x99", "external_jump"), ("jmp rax", "external_jump"),
    ("jmp qword ptr [rip + 0x10]", None), ("jrcxz 0x99", None), ("notrack jmp rax", None), ("mov eax, 1 ; call 0x20", None), ("call 0x20\n  jmp 0x99", "call"),
    ("jmp qword ptr [rax]", "external_jump"), ("call", None),
]


def test_leaf_filter(spark):
    files = rows(spark, [f"; Function: f\n\nblock_0x10:\n  {x}\n" for x, _ in LEAVES], "content")
    got = asm_filter.with_verdict(files).orderBy("i").collect()
    assert [r["reason"] for r in got] == [reason for _, reason in LEAVES]
    assert asm_filter.with_verdict(spark.createDataFrame([(None,)], "content string")).first()["kept"] is False


COMPARED = [
    ("1", "1.0", False), ("true", "1", False), ("1.0", "1.0000000001", True), ("0.0", "1e-12", False), ("[1,2]", "[1]", False), ("{}", '{"a":1}', True),
    ('{"a":1}', "{}", False), ("NaN", "NaN", False), ("null", "null", True), ("{", "1", None), ('[{"a":[1.5]}]', '[{"a":[1.5],"b":0}]', True),
]


def test_comparison(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(COMPARED)], "i int, a string, b string")
    assert [r["s"] for r in df.select("i", verify.same_json("a", "b").alias("s")).orderBy("i").collect()] == [c[2] for c in COMPARED]
    assert not verify.same_value(math.nan, math.nan)


FENCES = [
    ("```c\nint x;\n```", "int x;"), ("```cpp\nint x;", "int x;"), ("```c int x;```", "```c int x;"), ("  int x;  ", "int x;"), ("```\na\n```\ntail", "a\n```\ntail"),
    ("", ""), (None, None), ("```", ""), ("```\n", "```"[:0]), ("a```", "a"),
]


def test_response_cleaning(spark):
    got = rows(spark, [a for a, _ in FENCES]).withColumn("y", text.clean_response(F.col("x"))).orderBy("i").collect()
    assert [r["y"] for r in got] == [b for _, b in FENCES]


def test_paths_and_addresses(spark):
    one = spark.createDataFrame([("a/b/7.asm", "m/x:y", " 0XAB ", "r.o/f.o", "noext", "/a/.b")], "p string, m string, a string, o string, n string, h string")
    r = one.select(
        text.result_path(F.lit("out"), F.col("m"), F.lit(".asm"), F.col("p")).alias("path"), text.address(F.col("a")).alias("addr"), text.with_extension(F.col("o"), ".txt").alias("txt"),
        text.legacy_path(F.col("p"), F.lit("m")).alias("legacy"), text.legacy_path(F.col("n"), F.lit("m")).alias("bare"), text.result_path(F.lit("out"), F.lit("m"), F.lit("hlil"), F.col("n")).alias("flat"),
        text.assemble_source(F.lit(None).cast("string"), F.lit("f")).alias("src"), text.strip_source_includes(F.lit('extern "C" {\n#include "x.c"\n}\n#include "/tmp/y.c"\nint a;')).alias("cpp"),
        text.percent(F.lit(1), F.lit(3)).alias("p1"), text.percent(F.lit(0), F.lit(0)).alias("p0"),
    ).first()
    assert r["path"] == "out/m_x_y/asm/a/b/7.c"
    assert (r["addr"], r["txt"], r["legacy"], r["bare"], r["flat"]) == ("ab", "r.o/f.txt", "a/b/7_m_response.asm", "noext_m_response", "out/m/hlil/noext.c")
    assert r["src"] == "\n\nf"
    assert r["cpp"].strip() == "int a;"
    assert (r["p1"], r["p0"]) == ("33.3%", "0.0%")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_are_looked_for_once_a_row(spark):
    df = rows(spark, views.ERRORS)
    for table in taxonomy.COMPILE.values():
        text = plan(taxonomy.with_labels(df, "x", table, "l").withColumn("again", F.col("l")).where("size(again) > 0"))
        assert text.count("no such file or directory)") <= 2 and text.count("missing ';')") == 1
    text = plan(taxonomy.with_execution_labels(df, "x").where("size(found) > 0").withColumn("again", F.size("found")))
    assert text.count("regexp_extract_all") == 1


def test_labels_of_reports_once_a_row_are_the_same(spark):
    df = rows(spark, [r[0] for r in REPORTS] + [None])
    for whole in (False, True):
        both = taxonomy.with_execution_labels(df, "x", whole=whole).select("found", taxonomy.execution_labels(F.col("x"), whole=whole).alias("own")).collect()
        assert [r["found"] for r in both] == [r["own"] for r in both]
    line = F.element_at(taxonomy.labels(F.col("x"), taxonomy.EXECUTION, ("unclassified", "unclassified")), 1)
    both = df.select(taxonomy.first_label(F.col("x"), taxonomy.EXECUTION, ("unclassified", "unclassified")).alias("a"), line.alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both]


def test_artifacts_of_a_small_file_are_made_by_all_cores(spark, tmp_path):
    spark.range(50).selectExpr("id AS event_id", "id % 7 AS user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for artifact in (views.compile_errors, views.exec_reports, views.asm):
        assert artifact(spark, str(tmp_path)).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

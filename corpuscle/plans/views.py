"""Artifacts shaped like those of the experiments, derived from the driver's tables: as DataFrames, and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["gpt-4o", "claude-sonnet", "o4-mini", "llama:70b/instruct"]
IRS = ["asm", "llil", "mlil", "hlil"]
OPTS = ["O0", "O1", "O2", "O3"]
ERRORS = [
    "a.c:3:5: error: expected ';' before '}' token",
    "error: expected expression before ')' token",
    "error: 'x' undeclared (first use in this function)",
    "error: conflicting types for 'f'",
    "note: previous declaration of 'f'",
    "multiple definition of `f'; first defined here",
    "fatal error: foo.h: No such file or directory",
    "undefined reference to `g'\ncollect2: error: ld returned 1 exit status",
    "error: invalid initializer",
    "error: assignment of read-only location '*p'",
    "error: called object is not a function or function pointer",
    "error: called object 'f' is not a function or function pointer",
    "error: invalid type argument of unary '*'",
    "warning: implicit declaration of function 'h'\nerror: too few arguments to function 'k'",
    "error: unknown type name 'int128'",
    "something else",
    "expected x\nbefore y",
    "EXPECTED ';' BEFORE x",
    "Assembler: operand size mismatch for `mov'",
]
FAILURES = [
    "Expected {'a': 1}, Got {'a': 2}",
    "Exception - Expecting value: line 1 column 1 (char 0)",
    "Exception - Command './x' timed out after 60 seconds",
    "Exception - boom",
]
INSTRUCTIONS = [
    "ret", "call 0x20", "CALL rax", "jmp 0x10", "JNE 0x10", "jmp 0x99", "jmp rax", "jmp qword ptr [rip + 0x10]", "jrcxz 0x99", "notrack jmp rax",
    "mov eax, 1 ; call 0x20", "jmp qword ptr [rax + 0x10]", "call",
]
TYPES = ["succeeded", "failed", "error", "errored"]
TICKS = "```"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.expr(f"cast({index} + 1 as int)"))


def functions(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("func_def"))
    docs = read(spark, sf, "documents").select((F.col("doc_id") + 1_000_000).alias("id"), F.col("text").alias("func_def"))
    return pages.unionByName(docs)


def _event_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The two numbers that artifacts of events are made of, dealt to all cores. A small file of them is one split, and makes texts that
    are many times as large and looked at for long."""
    return read(spark, sf, "events").select("event_id", "user_id").repartition(max(4 * spark.sparkContext.defaultParallelism, 32))


def _config(events: DataFrame) -> list[Column]:
    return [
        F.concat(F.lit("iteration_"), F.expr("1 + event_id % 5")).alias("iteration"), _pick(MODELS, "user_id % 4").alias("model"),
        _pick(IRS, "event_id div 5 % 4").alias("ir"), _pick(OPTS, "event_id div 20 % 4").alias("opt"),
    ]


def compile_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_ids(spark, sf)
    n = F.col("event_id").cast("string")
    head = F.concat(F.lit("Compilation error for function ID "), n, F.lit("\nSource file: in/"), n, F.lit(".c\nTimestamp: 2024-01-01T00:00:00\nCommand: gcc -c\n\nSTDERR:\n"))
    second = F.when(F.expr("event_id % 3 = 0"), F.concat(F.lit("\n"), _pick(ERRORS, "event_id * 7 % 19"))).otherwise(F.lit(""))
    return e.select(*_config(e), F.concat(n, F.lit(".error")).alias("file"), F.concat(head, _pick(ERRORS, "event_id % 19"), second).alias("content"))


def exec_reports(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_ids(spark, sf).withColumn("passed", F.expr("cast(event_id % 11 as int)"))
    n = F.col("event_id").cast("string")
    messages = F.array(*(F.lit(m) for m in FAILURES))
    line = lambda k: F.concat(F.lit("  - Test "), k.cast("string"), F.lit(": "), F.element_at(messages, ((F.col("event_id") + k) % 4 + 1).cast("int")))
    failed = F.when(F.col("passed") < 10, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(10 - F.col("passed"), F.lit(1))), line), "\n")).otherwise(F.lit(""))
    head = F.concat(F.lit("Function: f"), n, F.lit("\nBinary: "), n, F.lit(".o\n"))
    tests = F.concat(head, F.lit("Tests: "), F.col("passed").cast("string"), F.lit("/10 passed ("), (F.col("passed") * 10).cast("string"), F.lit(".0%)\n"))
    good = F.concat(tests, F.lit("Status: ALL TESTS PASSED"))
    bad = F.concat(tests, F.lit("Status: SOME TESTS FAILED\n\nFailed tests:\n"), failed)
    broken = F.concat(head, F.lit("Status: COMPILATION/EXECUTION ERROR\nError: no binary"))
    content = F.when(F.expr("event_id % 13 = 0"), broken).when(F.col("passed") == 10, good).otherwise(bad)
    return e.select(*_config(e), F.concat(n, F.lit(".txt")).alias("file"), content.alias("content"))


def asm(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_ids(spark, sf)
    n = F.col("event_id").cast("string")
    lines = [F.lit("; Function: f"), n, F.lit("\n; Address: 0x10\n; Size: 9\n\nblock_0x10:\n  mov eax, 1\n  "), _pick(INSTRUCTIONS, "event_id % 13"), F.lit("\n  "), _pick(INSTRUCTIONS, "event_id * 5 % 7 * 2 % 13"), F.lit("\n  ret\n")]
    return e.select(F.concat(F.lit("f"), n).alias("name"), F.concat(*lines).alias("content"))


def function_map(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("line_num"), F.col("p_name").alias("name"), F.concat(F.lit("0x"), F.lower(F.hex(F.expr("4194304 + 16 * p_partkey")))).alias("addr"))


def document_map(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id"), F.concat(F.lit("0x"), F.lower(F.hex("doc_id"))).alias("addr"))


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus lines, some of which can't be read or lack an id or a definition."""
    d = read(spark, sf, "documents")
    lost = lambda n, c: F.when(F.expr(f"doc_id % {n} <> 0"), c)
    return d.select(
        F.col("doc_id").alias("line_num"), lost(97, F.col("doc_id")).alias("id"), F.coalesce(lost(89, F.col("text")), F.lit("")).alias("func_def"),
        F.when(F.expr("doc_id % 83 = 0"), "Expecting value").alias("fault"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "labels")
    text = F.when(F.col("toxic") == 1, "no verdict").when(F.col("quality") == 1, "Processing\nSUCCESS").otherwise("Processing\nFAILED: assertion")
    prefix = F.when(F.expr("doc_id % 2 = 0"), F.lit("0x")).otherwise(F.lit(""))
    return t.select(F.concat(prefix, F.lower(F.hex("doc_id"))).alias("identifier"), text.alias("content"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    n = F.col("event_id").cast("string")
    status = F.when(F.col("event_type") == "error", "ERROR").otherwise("SUCCESS")
    details = F.when(F.expr("event_id % 7 = 0"), F.lit("left|right")).otherwise(F.lit("done"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return e.select(F.concat_ws("|", status, F.upper("event_type"), F.concat(n, F.lit(".c")), F.concat(F.lit("out/"), n, F.lit(".c")), stamp, details).alias("value"))


def batch_lines(spark: SparkSession, sf: str) -> DataFrame:
    """provider, raw: lines as the two providers return them."""
    e = read(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    cid = F.concat(F.lit("m_file_"), F.when(F.expr("event_id % 10 = 9"), F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string")))
    kind = _pick(TYPES, "event_id % 4")
    body = F.format_string('{"custom_id":"%s","response":{"body":{"choices":[{"message":{"content":"int f%d;"}}],"usage":{"prompt_tokens":%d,"completion_tokens":%d,"total_tokens":%d}}},"error":null}', cid, "event_id", "k", F.col("k") + 1, F.col("k") * 2 + 1)
    lost = F.format_string('{"custom_id":"%s","response":null,"error":"server"}', cid)
    good = F.format_string('{"custom_id":"%s","result":{"type":"succeeded","message":{"content":[{"text":"int g%d;"}],"usage":{"input_tokens":%d,"output_tokens":%d}}}}', cid, "event_id", "k", F.col("k") + 2)
    bad = F.format_string('{"custom_id":"%s","result":{"type":"%s","error":"overloaded"}}', cid, kind)
    first = F.when(kind == "succeeded", body).otherwise(lost)
    second = F.when(kind == "succeeded", good).otherwise(bad)
    return e.select(F.when(F.expr("user_id % 2 = 0"), F.lit("openai")).otherwise(F.lit("anthropic")).alias("provider"), F.when(F.expr("user_id % 2 = 0"), first).otherwise(second).alias("raw"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.concat(F.lit("m_file_"), F.col("event_id").cast("string")).alias("custom_id"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "conversations").where("role = 'assistant'")
    fence = F.lit(TICKS)
    text = F.col("text")
    wrapped = (
        F.when(F.expr("turn % 4 = 0"), F.concat(F.lit("  \n"), text, F.lit("\n "))).when(F.expr("turn % 4 = 1"), F.concat(fence, F.lit("c\n"), text, F.lit("\n"), fence))
        .when(F.expr("turn % 4 = 2"), F.concat(fence, F.lit("\n"), text, fence)).otherwise(F.concat(fence, F.lit("c")))
    )
    return t.select("conv_id", "turn", wrapped.alias("response"))


# the same as SQL


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


_CONFIG = f"'iteration_' || (1 + event_id % 5) AS iteration, {_list(MODELS)}[user_id % 4 + 1] AS model, {_list(IRS)}[event_id // 5 % 4 + 1] AS ir, {_list(OPTS)}[event_id // 20 % 4 + 1] AS opt"

SQL = {
    "v_functions": "SELECT page_id::BIGINT AS id, html AS func_def FROM pages UNION ALL SELECT doc_id + 1000000, text FROM documents",
    "v_compile_errors": f"""SELECT {_CONFIG}, event_id || '.error' AS file,
  'Compilation error for function ID ' || event_id || chr(10) || 'Source file: in/' || event_id || '.c' || chr(10) || 'Timestamp: 2024-01-01T00:00:00' || chr(10) || 'Command: gcc -c' || chr(10) || chr(10) || 'STDERR:' || chr(10)
  || {_list(ERRORS)}[event_id % 19 + 1] || CASE WHEN event_id % 3 = 0 THEN chr(10) || {_list(ERRORS)}[event_id * 7 % 19 + 1] ELSE '' END AS content FROM events""",
    "v_exec_reports": f"""SELECT {_CONFIG}, event_id || '.txt' AS file, CASE WHEN event_id % 13 = 0 THEN head || 'Status: COMPILATION/EXECUTION ERROR' || chr(10) || 'Error: no binary'
  WHEN passed = 10 THEN tests || 'Status: ALL TESTS PASSED' ELSE tests || 'Status: SOME TESTS FAILED' || chr(10) || chr(10) || 'Failed tests:' || chr(10)
  || array_to_string(list_transform(range(1, 11 - passed), lambda k: '  - Test ' || k || ': ' || {_list(FAILURES)}[(event_id + k) % 4 + 1]), chr(10)) END AS content
FROM (SELECT *, head || 'Tests: ' || passed || '/10 passed (' || passed * 10 || '.0%)' || chr(10) AS tests FROM (
  SELECT *, event_id % 11 AS passed, 'Function: f' || event_id || chr(10) || 'Binary: ' || event_id || '.o' || chr(10) AS head FROM events))""",
    "v_asm": f"""SELECT 'f' || event_id AS name, '; Function: f' || event_id || chr(10) || '; Address: 0x10' || chr(10) || '; Size: 9' || chr(10) || chr(10) || 'block_0x10:' || chr(10) || '  mov eax, 1' || chr(10) || '  '
  || {_list(INSTRUCTIONS)}[event_id % 13 + 1] || chr(10) || '  ' || {_list(INSTRUCTIONS)}[event_id * 5 % 7 * 2 % 13 + 1] || chr(10) || '  ret' || chr(10) AS content FROM events""",
    "v_map": "SELECT p_partkey AS line_num, p_name AS name, '0x' || lower(to_hex(4194304 + 16 * p_partkey)) AS addr FROM part",
    "v_document_map": "SELECT doc_id, '0x' || lower(to_hex(doc_id)) AS addr FROM documents",
    "v_corpus_lines": """SELECT doc_id AS line_num, CASE WHEN doc_id % 97 <> 0 THEN doc_id END AS id, coalesce(CASE WHEN doc_id % 89 <> 0 THEN text END, '') AS func_def,
  CASE WHEN doc_id % 83 = 0 THEN 'Expecting value' END AS fault FROM documents""",
    "v_logs": """SELECT CASE WHEN doc_id % 2 = 0 THEN '0x' ELSE '' END || lower(to_hex(doc_id)) AS identifier,
  CASE WHEN toxic = 1 THEN 'no verdict' WHEN quality = 1 THEN 'Processing' || chr(10) || 'SUCCESS' ELSE 'Processing' || chr(10) || 'FAILED: assertion' END AS content FROM labels""",
    "v_log_lines": """SELECT concat_ws('|', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END, upper(event_type), event_id || '.c', 'out/' || event_id || '.c', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
  CASE WHEN event_id % 7 = 0 THEN 'left|right' ELSE 'done' END) AS value FROM events""",
    "v_results": f"""SELECT provider, custom_id, CASE WHEN kind = 'succeeded' THEN CASE WHEN provider = 'openai' THEN 'int f' || event_id || ';' ELSE 'int g' || event_id || ';' END END AS response,
  CASE WHEN kind <> 'succeeded' AND provider = 'openai' THEN 'server' WHEN kind IN ('failed', 'error') THEN 'overloaded' END AS error,
  CASE WHEN kind = 'succeeded' THEN k ELSE 0 END AS input_tokens, CASE WHEN kind = 'succeeded' THEN CASE WHEN provider = 'openai' THEN k + 1 ELSE k + 2 END ELSE 0 END AS output_tokens
FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, {_list(TYPES)}[event_id % 4 + 1] AS kind, (props->>'$.k')::BIGINT AS k,
  'm_file_' || CASE WHEN event_id % 10 = 9 THEN 'x' ELSE '' END || event_id AS custom_id FROM events)""",
    "v_responses": """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  ' || chr(10) || text || chr(10) || ' ' WHEN 1 THEN '```c' || chr(10) || text || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || text || '```' ELSE '```c' END AS response
FROM conversations WHERE role = 'assistant'""",
}


def sql(query: str) -> str:
    """The query with the views that it names in front."""
    used = [n for n in SQL if n in query]
    return ("WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in used) + " " if used else "") + query

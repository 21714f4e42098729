"""The registered queries of the engine, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import halstead, taxonomy, text
from corpuscle.operators import asm_filter, batch, coverage, deep_compare, distribution, rollup, sampling, verify
from corpuscle.plans import files, states  # noqa: F401  they register queries too
from corpuscle.plans import views as v
from corpuscle.plans.labels import CONFIG_STATS as _CONFIG_STATS
from corpuscle.plans.labels import compile_labels as _compile_labels
from corpuscle.plans.labels import sql_compile as _sql_compile
from corpuscle.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the entry takes them from here
from corpuscle.sources import disassembly, readers, sinks
from corpuscle.sources.readers import parse_log_lines
from corpuscle.sources.shared import scratch
from corpuscle.streaming import ingest

# complexity, buckets, samples

_COUNTS = halstead.sql_counts("v_functions", "id", "func_def")
_METRICS = f"(SELECT *, {halstead.SQL_DIFFICULTY} AS difficulty FROM ({_COUNTS}))"
_BUCKETS = f"(SELECT id, ceil(difficulty)::INTEGER AS bucket FROM {_METRICS} WHERE difficulty BETWEEN 1.0 AND 75.0)"
_SAMPLED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || id), id) AS place FROM {_BUCKETS}) WHERE place <= 25)"


@query(halstead.sql_counts("pages", "page_id", "html"))
def halstead_counts(spark: SparkSession, sf: str) -> DataFrame:
    return halstead.with_counts(v.read(spark, sf, "pages").select("page_id", "html"), "html").drop("html")


@query(halstead.sql_counts("documents", "doc_id", "text"))
def halstead_counts_docs(spark: SparkSession, sf: str) -> DataFrame:
    return halstead.with_counts(v.read(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"""SELECT page_id, n1_distinct + n2_distinct AS vocabulary, n1_total + n2_total AS program_length, round({halstead.SQL_DIFFICULTY}, 3) AS difficulty,
round(CASE WHEN n1_distinct + n2_distinct > 1 THEN (n1_total + n2_total) * log2(n1_distinct + n2_distinct) ELSE 0.0 END, 3) AS volume,
round({halstead.SQL_DIFFICULTY} * CASE WHEN n1_distinct + n2_distinct > 1 THEN (n1_total + n2_total) * log2(n1_distinct + n2_distinct) ELSE 0.0 END / 1000, 1) AS effort_thousands
FROM ({halstead.sql_counts("pages", "page_id", "html")})""")
def halstead_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = halstead.with_metrics(v.read(spark, sf, "pages").select("page_id", "html"), "html")
    return out.select("page_id", "vocabulary", "program_length", F.round("difficulty", 3).alias("difficulty"), F.round("volume", 3).alias("volume"), F.round(F.col("effort") / 1000, 1).alias("effort_thousands"))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    out = halstead.with_metrics(v.functions(spark, sf), "func_def").select("id", "difficulty")
    return out.where(sampling.in_range(F.col("difficulty"))).select("id", halstead.difficulty_bucket(F.col("difficulty")).alias("bucket"))


@query(f"""SELECT bucket, printf('%.1f...1-%.1f', greatest(bucket - 1, 0)::DOUBLE, bucket::DOUBLE) AS label, count(*) AS total, least(count(*), 25) AS selected, round(least(count(*), 25) / count(*) * 100, 4) AS percentage
FROM {_BUCKETS} GROUP BY bucket""")
def difficulty_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _bucketed(spark, sf)
    return sampling.bucket_stats(rows, "bucket").withColumn("label", halstead.bucket_label(F.col("bucket")))


@query(f"SELECT bucket, printf('%.1f-%.1f', greatest(bucket - 1, 0)::DOUBLE, bucket::DOUBLE) AS label, count(*) AS total FROM {_BUCKETS} GROUP BY bucket ORDER BY total DESC, bucket LIMIT 20")
def largest_buckets(spark: SparkSession, sf: str) -> DataFrame:
    stats = _bucketed(spark, sf).groupBy("bucket").agg(F.count("*").alias("total"))
    return sampling.largest_buckets(stats, "bucket").withColumn("label", halstead.bucket_label(F.col("bucket"), academic=False))


@query(f"""SELECT count(*) AS total, count(difficulty) AS processed, count(*) - count(difficulty) AS excluded, count(*) FILTER (difficulty NOT BETWEEN 1.0 AND 120.0) AS out_of_range,
printf('%.2f%%', count(difficulty) * 100.0 / count(*)) AS rate FROM (SELECT f.id, m.difficulty FROM v_functions f LEFT JOIN {_METRICS} m ON f.id = m.id AND f.func_def <> '')""")
def measure_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = halstead.with_metrics(v.functions(spark, sf), "func_def").select("difficulty")
    out = d.agg(F.count("*").alias("total"), F.count("difficulty").alias("processed"), F.count_if(~sampling.in_range(F.col("difficulty"), 1.0, 120.0)).alias("out_of_range"))
    return out.withColumn("excluded", F.col("total") - F.col("processed")).withColumn("rate", text.percent(F.col("processed"), F.col("total"), 2))


@query(f"SELECT id, bucket, place FROM {_SAMPLED}")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(_bucketed(spark, sf), "bucket", "id").select("id", "bucket", F.col("place").cast("long").alias("place"))


@query()
def stratified_sample_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.exact_sample(_bucketed(spark, sf), "bucket", "id").select("id", "bucket", "position", "output_order")


# taxonomies


@query(f"SELECT file, category, subcategory FROM {_sql_compile()}")
def compile_taxonomy_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _compile_labels(spark, sf).select("file", "category", "subcategory")


@query(_CONFIG_STATS.format(keys="iteration, model, ir, opt", rows=_sql_compile()))
def compile_taxonomy_by_config(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["iteration", *rollup.CONFIG]
    return rollup.config_stats(rollup.label_counts(_compile_labels(spark, sf), keys), keys)


@query(f"""SELECT *, sum(n_labels) OVER (PARTITION BY iteration)::BIGINT AS n_total, sum(n_labels) OVER (PARTITION BY iteration, category)::BIGINT AS n_category,
n_labels / sum(n_labels) OVER (PARTITION BY iteration, category) AS proportion_of_category, n_labels / sum(n_labels) OVER (PARTITION BY iteration) AS proportion_of_total
FROM (SELECT coalesce(iteration, '(all)') AS iteration, category, subcategory, count(*) AS n_labels FROM {_sql_compile()} GROUP BY GROUPING SETS ((iteration, category, subcategory), (category, subcategory)))""")
def compile_taxonomy_by_iteration(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.iteration_rollup(rollup.label_counts(_compile_labels(spark, sf), ["iteration", *rollup.CONFIG]))


@query(_CONFIG_STATS.format(keys="model, ir, opt", rows=_sql_compile("consolidated")))
def compile_taxonomy_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.config_stats(rollup.label_counts(_compile_labels(spark, sf, "consolidated"), rollup.CONFIG), rollup.CONFIG)


@query(f"SELECT model, ir, opt, n_labels, n_files FROM (SELECT model, ir, opt, count(*) AS n_labels, count(DISTINCT file) AS n_files FROM {_sql_compile()} GROUP BY ALL)")
def compile_taxonomy_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = taxonomy.with_labels(v.compile_errors(spark, sf), "content", taxonomy.COMPILE_DETAILED)
    return rows.groupBy(*rollup.CONFIG).agg(F.sum(F.size("found")).alias("n_labels"), F.count("*").alias("n_files"))


_EXEC = f"(SELECT *, CASE WHEN contains(content, '0/10 passed (0.0%)') THEN 'allfailed' ELSE 'partialfailed' END AS failure_type, {taxonomy.sql_execution_labels('content')} AS found FROM v_exec_reports)"
_EXEC_ROWS = f"(SELECT * EXCLUDE (l), l.category AS category, l.subcategory AS subcategory FROM (SELECT iteration, model, ir, opt, file, failure_type, unnest(found) AS l FROM {_EXEC}))"


def _exec(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    return taxonomy.with_execution_labels(v.exec_reports(spark, sf).withColumn("failure_type", taxonomy.failure_type(c)), "content").drop("content")


@query(f"SELECT file, failure_type, category, subcategory FROM {_EXEC_ROWS}")
def exec_taxonomy_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.explode_labels(_exec(spark, sf), F.col("found")).select("file", "failure_type", "category", "subcategory")


@query(f"""SELECT failure_type, category, subcategory, count(*) AS n_labels, count(DISTINCT file) AS n_files
FROM (SELECT * EXCLUDE (failure_type), unnest([failure_type, 'combined']) AS failure_type FROM {_EXEC_ROWS}) GROUP BY ALL""")
def exec_failure_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.explode_labels(_exec(spark, sf), F.col("found")).withColumn("failure_type", F.explode(F.array("failure_type", F.lit("combined"))))
    # a file has a label once, so files are counted without a distinct
    return rows.groupBy("failure_type", "category", "subcategory").agg(F.count("*").alias("n_labels"), F.count("*").alias("n_files"))


_EXEC_TYPES = f"(SELECT * EXCLUDE (failure_type), unnest([failure_type, 'combined']) AS failure_type FROM {_EXEC_ROWS})"
_TYPE_KEYS = ["failure_type", "iteration", *rollup.CONFIG]


@query(_CONFIG_STATS.format(keys=", ".join(_TYPE_KEYS), rows=_EXEC_TYPES))
def exec_failure_type_by_config(spark: SparkSession, sf: str) -> DataFrame:
    rows = rollup.explode_labels(_exec(spark, sf), F.col("found")).withColumn("failure_type", F.explode(F.array("failure_type", F.lit("combined"))))
    return rollup.config_stats(rollup.label_counts(rows, _TYPE_KEYS), _TYPE_KEYS)


@query(f"""SELECT *, n_files / total_labels AS label_share FROM (SELECT array_to_string(list_sort(list_transform(found, lambda x: x.category || ':' || x.subcategory)), ',') AS combination, count(*) AS n_files
FROM {_EXEC} WHERE found IS NOT NULL GROUP BY ALL ORDER BY n_files DESC, combination LIMIT 10), (SELECT count(*) AS total_labels FROM {_EXEC_ROWS})""")
def exec_combination_label_shares(spark: SparkSession, sf: str) -> DataFrame:
    files = _exec(spark, sf)
    counts = rollup.label_counts(rollup.explode_labels(files, F.col("found")), [])
    return rollup.label_shares(rollup.combinations(files, F.col("found"), []), counts, 10)


_COMBOS = f"""(SELECT failure_type, array_to_string(list_sort(list_transform(found, lambda x: x.category || ':' || x.subcategory)), ',') AS combination, count(*) AS n_files
FROM (SELECT * EXCLUDE (failure_type), unnest([failure_type, 'combined']) AS failure_type FROM {_EXEC} WHERE found IS NOT NULL) GROUP BY ALL)"""


@query(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY failure_type ORDER BY n_files DESC, combination) AS place,
round(n_files / sum(n_files) OVER (PARTITION BY failure_type) * 100, 4) AS pct_of_files FROM {_COMBOS}) WHERE place <= CASE WHEN failure_type = 'combined' THEN 10 ELSE 5 END""")
def exec_combinations_topk(spark: SparkSession, sf: str) -> DataFrame:
    files = _exec(spark, sf).withColumn("failure_type", F.explode(F.array("failure_type", F.lit("combined"))))
    counts = rollup.combinations(files, F.col("found"), ["failure_type"])
    whole = counts.groupBy("failure_type").agg(F.sum("n_files").alias("n"))
    top = rollup.top_combinations(counts, "failure_type", 10).where("failure_type = 'combined' or place <= 5").join(whole, "failure_type")
    return top.select("failure_type", "combination", "n_files", F.col("place").cast("long").alias("place"), F.round(F.col("n_files") / F.col("n") * 100, 4).alias("pct_of_files"))


_EXEC_ALL = f"(SELECT * EXCLUDE (l), l.category AS category, l.subcategory AS subcategory FROM (SELECT model, ir, opt, file, unnest({taxonomy.sql_execution_labels('content', whole=True)}) AS l FROM v_exec_reports))"


@query(f"""SELECT s.*, t.top_category FROM ({_CONFIG_STATS.format(keys="model, ir, opt", rows=_EXEC_ALL)}) s JOIN (
SELECT model, ir, opt, category AS top_category FROM (SELECT *, row_number() OVER (PARTITION BY model, ir, opt ORDER BY n DESC, category) AS r FROM (
  SELECT model, ir, opt, category, count(*) AS n FROM {_EXEC_ALL} GROUP BY ALL)) WHERE r = 1) t USING (model, ir, opt)""")
def exec_taxonomy_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    files = taxonomy.with_execution_labels(v.exec_reports(spark, sf), "content", whole=True)
    rows = rollup.explode_labels(files, F.col("found"))
    counts = rollup.label_counts(rows, rollup.CONFIG)
    top = rollup.top_category(counts, rollup.CONFIG).drop("n_category")
    return rollup.config_stats(counts, rollup.CONFIG).join(top, rollup.CONFIG)


@query(f"""SELECT model, ir, opt, category, n_labels FROM (SELECT *, dense_rank() OVER (ORDER BY model) AS a, dense_rank() OVER (PARTITION BY model ORDER BY ir) AS b, dense_rank() OVER (PARTITION BY model, ir ORDER BY opt) AS c,
dense_rank() OVER (PARTITION BY model, ir, opt ORDER BY category) AS d FROM (SELECT model, ir, opt, category, count(*) AS n_labels FROM {_sql_compile()} GROUP BY ALL)) WHERE a <= 2 AND b <= 2 AND c <= 2 AND d <= 3""")
def taxonomy_display(spark: SparkSession, sf: str) -> DataFrame:
    counts = _compile_labels(spark, sf).groupBy(*rollup.CONFIG, "category").agg(F.count("*").alias("n_labels"))
    return rollup.first_values(counts, [*rollup.CONFIG, "category"], {"model": 2, "ir": 2, "opt": 2, "category": 3})


# leaf functions

_REGS = "[" + ", ".join(f"'{r}'" for r in asm_filter.REGISTERS) + "]"
_ASM = f"""(SELECT name, CASE WHEN len(list_filter(code, lambda x: regexp_matches(x, '(?i)^call[ \\t]+'))) > 0 THEN 'call'
WHEN len(list_filter(operands, lambda o: list_contains({_REGS}, lower(o)) OR ((contains(lower(o), '[') OR contains(lower(o), 'ptr')) AND len(list_filter({_REGS}, lambda r: contains(lower(o), r))) > 0)
  OR (regexp_extract(o, '(0x[0-9a-fA-F]+)', 1) <> '' AND NOT list_contains(blocks, lower(regexp_extract(o, '(0x[0-9a-fA-F]+)', 1)))))) > 0 THEN 'external_jump' END AS reason
FROM (SELECT name, list_transform(regexp_extract_all(content, '(?m)^block_(0x[0-9a-fA-F]+):', 1), lambda x: lower(x)) AS blocks, code,
  list_transform(list_filter(code, lambda x: regexp_matches(x, '(?i)^j[a-z]{{1,3}}[ \\t]+.')), lambda x: trim(regexp_extract(x, '(?i)^j[a-z]{{1,3}}[ \\t]+(.+)$', 1))) AS operands
  FROM (SELECT name, content, list_transform(string_split(content, chr(10)), lambda x: trim(string_split(x, ';')[1])) AS code FROM v_asm)))"""


@query(f"SELECT name, reason, reason IS NULL AS kept FROM {_ASM}")
def asm_leaf_filter(spark: SparkSession, sf: str) -> DataFrame:
    return asm_filter.with_verdict(v.asm(spark, sf)).select("name", "reason", "kept")


@query(f"SELECT count(*) AS n_files, count(*) FILTER (reason IS NULL) AS n_kept, count(*) FILTER (reason = 'call') AS n_call, count(*) FILTER (reason = 'external_jump') AS n_external_jump FROM {_ASM}")
def asm_filter_summary(spark: SparkSession, sf: str) -> DataFrame:
    return asm_filter.summary(asm_filter.with_verdict(v.asm(spark, sf)))


_KNOWN = "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'n/f' || event_id WHEN event_id % 7 = 0 THEN 'f' || (event_id - 1) ELSE 'f' || event_id END AS name FROM events)"
_STEMS = f"(SELECT CASE WHEN substr(name, 2)::BIGINT % 5 = 0 THEN 'n_' || name ELSE name END AS name, reason FROM {_ASM})"


@query(f"SELECT event_id, name FROM {_KNOWN} WHERE name IN (SELECT name FROM {_STEMS} WHERE reason IS NULL)")
def leaf_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a slash, which no file's stem has, are never found; of names that two functions have, both are."""
    n = F.col("event_id").cast("string")
    name = F.when(F.expr("event_id % 5 = 0"), F.concat(F.lit("n/f"), n)).when(F.expr("event_id % 7 = 0"), F.concat(F.lit("f"), (F.col("event_id") - 1).cast("string"))).otherwise(F.concat(F.lit("f"), n))
    known = v.read(spark, sf, "events").select("event_id", name.alias("name"))
    listed = F.when(F.expr("cast(substring(name, 2) as long) % 5 = 0"), F.concat(F.lit("n/"), "name")).otherwise(F.col("name"))
    files = v.asm(spark, sf).withColumn("name", text.safe_name(listed))
    return asm_filter.passing_functions(known, asm_filter.with_verdict(files))


# joins of artifacts


@query("SELECT doc_id, addr FROM v_document_map WHERE doc_id IN (SELECT doc_id FROM labels)")
def usable_functions(spark: SparkSession, sf: str) -> DataFrame:
    files = v.read(spark, sf, "labels").select(F.concat(F.lit("0x"), F.lower(F.hex("doc_id"))).alias("addr"))
    return coverage.usable(v.document_map(spark, sf), files).select("doc_id", "addr")


@query("SELECT (SELECT count(*) FROM v_document_map) AS n_map, (SELECT count(*) FROM v_document_map WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing")
def unusable_count(spark: SparkSession, sf: str) -> DataFrame:
    files = v.read(spark, sf, "labels").select(F.concat(F.lit("0x"), F.lower(F.hex("doc_id"))).alias("addr"))
    every = v.document_map(spark, sf)
    return every.agg(F.count("*").alias("n_map")).crossJoin(coverage.unusable(every, files).agg(F.count("*").alias("n_missing")))  # one row each


_VERDICTS = "(SELECT identifier, CASE WHEN contains(content, 'FAILED') THEN 'failed' WHEN contains(content, 'SUCCESS') THEN 'passed' END AS v FROM v_logs)"


@query(f"""SELECT m.doc_id, m.addr, CASE coalesce(a.v, b.v) WHEN 'failed' THEN 'covered' WHEN 'passed' THEN 'uncovered' ELSE 'missing' END AS coverage
FROM v_document_map m LEFT JOIN {_VERDICTS} a ON a.identifier = m.addr AND a.v IS NOT NULL LEFT JOIN {_VERDICTS} b ON b.identifier = replace(m.addr, '0x', '') AND b.v IS NOT NULL""")
def coverage_classification(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.classify_coverage(v.document_map(spark, sf), v.logs(spark, sf)).select("doc_id", "addr", "coverage")


@query("""SELECT m.doc_id, length(coalesce(a.content, b.content)) AS n_chars FROM v_document_map m LEFT JOIN v_logs a ON a.identifier = m.addr LEFT JOIN v_logs b ON b.identifier = replace(m.addr, '0x', '')
WHERE coalesce(a.content, b.content) IS NOT NULL""")
def map_with_code(spark: SparkSession, sf: str) -> DataFrame:
    files = v.logs(spark, sf).withColumnRenamed("identifier", "addr")
    out = coverage.with_code(v.document_map(spark, sf), files).where("content is not null")
    return out.select("doc_id", F.length("content").cast("long").alias("n_chars"))


@query("""SELECT count(*) AS n_candidates, count(l.doc_id) AS n_ok, count(*) - count(l.doc_id) AS n_errors FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def recompile_funnel(spark: SparkSession, sf: str) -> DataFrame:
    meta = v.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("func_def"), F.col("doc_id").alias("line_num"))
    out = coverage.recompile_inputs(v.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id")), meta)
    return out.agg(F.count("*").alias("n_candidates"), F.count_if(F.col("error").isNull()).alias("n_ok"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


@query("""SELECT opt, count(*) FILTER (length(text) > 0) AS compiled, count(*) FILTER (length(text) % 10 = 0) AS errors FROM documents, (SELECT unnest(['O0', 'O1', 'O2', 'O3']) AS opt) GROUP BY opt""")
def opt_level_expansion(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.read(spark, sf, "documents").select(F.length("text").alias("n"))
    out = coverage.expand(docs, "opt", coverage.OPT_LEVELS).groupBy("opt")
    return out.agg(F.count_if(F.col("n") > 0).alias("compiled"), F.count_if(F.col("n") % 10 == 0).alias("errors"))


_LINES = """(SELECT *, CASE WHEN fault IS NOT NULL THEN 'Error parsing JSON at line ' || line_num || ': ' || fault WHEN id IS NULL THEN 'Line ' || line_num || ': ''id'' field not found'
WHEN coalesce(func_def, '') = '' THEN 'Line ' || line_num || ' (ID=' || id || '): func_def not found' END AS told FROM v_corpus_lines)"""
_FUNNEL = f"""(SELECT line_num, opt, CASE WHEN opt IS NULL THEN told WHEN length(func_def) % 10 = 0 THEN 'Error compiling function ID=' || id || ' (optimization=' || opt || '): no object' END AS message
FROM (SELECT *, unnest(CASE WHEN told IS NULL THEN ['O0', 'O1', 'O2', 'O3'] ELSE [NULL] END) AS opt FROM {_LINES}))"""


def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    """line_num, opt and message (null where compiled); a definition of 10, 20, ... characters stands for one that does not compile."""
    rows = coverage.funnel(v.corpus_lines(spark, sf))
    lost = F.when(F.length("func_def") % 10 == 0, F.format_string("Error compiling function ID=%d (optimization=%s): no object", "id", "opt"))
    return rows.select("line_num", "opt", F.when(F.col("opt").isNull(), F.col("message")).otherwise(lost).alias("message"))


@query(f"SELECT line_num, opt, message FROM {_FUNNEL}")
def functions_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return _funnel(spark, sf)


@query(f"SELECT opt, count(*) AS attempted, count(*) FILTER (message IS NULL) AS compiled, count(message) AS errors FROM (SELECT message, unnest(CASE WHEN opt IS NULL THEN ['(all)'] ELSE [opt, '(all)'] END) AS opt FROM {_FUNNEL}) GROUP BY opt")
def level_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.level_counts(_funnel(spark, sf))


# Lines around the messages of an error log.
_LOG_HEAD = ["File processed: documents", "Optimization levels: O0, O1, O2, O3", ""]
_LOG_TRAILER = [
    "", "=== Summary ===", "Total function compilations attempted: %(attempted)d", "Total compilations successful: %(compiled)d", "Total compilation errors: %(errors)d", "",
    "=== Breakdown by Optimization Level ===", *(f"{x}: %(compiled_{x})d compiled, %(errors_{x})d errors" for x in coverage.OPT_LEVELS),
]
_LEVEL_SQL = " ".join(f"UNION ALL SELECT 2, {7 + i}, '{x}: ' || count(*) FILTER (opt = '{x}' AND message IS NULL) || ' compiled, ' || count(message) FILTER (opt = '{x}') || ' errors' FROM f" for i, x in enumerate(coverage.OPT_LEVELS))
_TRAILER_SQL = " ".join(f"UNION ALL SELECT 2, {i}, '{x}'" for i, x in enumerate(_LOG_TRAILER) if "%" not in x)


@query(f"""SELECT * FROM (WITH f AS (SELECT * FROM {_FUNNEL}) SELECT 0 AS part, i AS place, x AS value FROM (SELECT unnest([0, 1, 2])::BIGINT AS i, unnest({v._list(_LOG_HEAD)}) AS x)
UNION ALL SELECT 1, line_num * 4 + CASE WHEN opt IS NULL THEN 0 ELSE right(opt, 1)::INTEGER END, message FROM f WHERE message IS NOT NULL {_TRAILER_SQL}
UNION ALL SELECT 2, 2, 'Total function compilations attempted: ' || count(*) FROM f UNION ALL SELECT 2, 3, 'Total compilations successful: ' || count(*) FILTER (message IS NULL) FROM f
UNION ALL SELECT 2, 4, 'Total compilation errors: ' || count(message) FROM f {_LEVEL_SQL})""")
def build_error_log(spark: SparkSession, sf: str) -> DataFrame:
    good, of = F.col("message").isNull(), lambda x: F.col("opt") == x
    counts = {"attempted": F.count("*"), "compiled": F.count_if(good), "errors": F.count("message")}
    for x in coverage.OPT_LEVELS:
        counts |= {f"compiled_{x}": F.count_if(of(x) & good), f"errors_{x}": F.count_if(of(x) & ~good)}
    place = F.col("line_num") * 4 + F.coalesce(F.right("opt", F.lit(1)).cast("int"), F.lit(0))
    return sinks.error_log(_LOG_HEAD, _funnel(spark, sf).withColumn("place", place), counts, _LOG_TRAILER)


@query("SELECT doc_id, ir, 'output/' || source || '/' || doc_id || '.' || ir AS path FROM documents, (SELECT unnest(['asm', 'hlil', 'llil', 'mlil']) AS ir)")
def representations_by_binary(spark: SparkSession, sf: str) -> DataFrame:
    files = v.read(spark, sf, "documents").select("doc_id", "source")
    return coverage.expand(files, "ir", coverage.REPRESENTATIONS).select("doc_id", "ir", F.concat(F.lit("output/"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), "ir"))).alias("path"))


@query(f"""SELECT doc_id, model, printf('%s_file_%04d', model, doc_id) AS custom_id, CASE WHEN contains(model, 'claude') THEN 'anthropic' ELSE 'openai' END AS provider
FROM documents, (SELECT unnest({v._list(v.MODELS)}) AS model)""")
def requests_by_model(spark: SparkSession, sf: str) -> DataFrame:
    files = coverage.expand(v.read(spark, sf, "documents").select("doc_id"), "model", v.MODELS)
    return files.select("doc_id", "model", text.custom_id(F.col("model"), F.col("doc_id")).alias("custom_id"), text.provider(F.col("model")).alias("provider"))


@query("""SELECT s_suppkey, lower(CASE WHEN starts_with(stem, '0x') THEN substr(stem, 3) ELSE stem END) AS addr FROM (
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '0x' ELSE '0X' END || upper(to_hex(4194304 + s_suppkey)) || CASE WHEN s_suppkey % 3 = 0 THEN '.v2' ELSE '' END AS stem FROM supplier)""")
def patch_file_addresses(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("in/a.b/"), F.when(F.expr("s_suppkey % 2 = 0"), "0x").otherwise("0X"), F.hex(F.expr("4194304 + s_suppkey")), F.when(F.expr("s_suppkey % 3 = 0"), ".v2").otherwise(""), F.lit(".c"))
    return v.read(spark, sf, "supplier").select("s_suppkey", text.file_address(name).alias("addr"))


@query("""SELECT s.s_suppkey, CASE WHEN m.name IS NULL THEN 'Address ' || s.addr || ' not found in JSON mapping' END AS error, m.name FROM (
  SELECT s_suppkey, ' 0X' || upper(to_hex(4194304 + 32 * s_suppkey * s_suppkey)) || ' ' AS addr FROM supplier) s
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(addr) ORDER BY line_num DESC) AS r FROM v_map) WHERE r = 1) m ON lower(trim(s.addr)) = m.addr""")
def address_normalize_join(spark: SparkSession, sf: str) -> DataFrame:
    s = v.read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" 0X"), F.hex(F.expr("4194304 + 32 * s_suppkey * s_suppkey")), F.lit(" ")).alias("addr"))
    return coverage.match_sources(s, v.function_map(spark, sf), "line_num").select("s_suppkey", "error", "name")


@query("SELECT d.doc_id, lpad(d.doc_id::VARCHAR, 9, '0') AS id, l.quality::VARCHAR AS verdict FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def integer_id_join(spark: SparkSession, sf: str) -> DataFrame:
    objects = v.read(spark, sf, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("id"))
    corpus = v.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("verdict"), F.col("doc_id").alias("line_num"))
    return coverage.by_integer_id(objects, corpus)


# representations


@query("""SELECT event_id, line, CASE line WHEN 0 THEN '0x10' ELSE '0x12' END AS address, CASE line WHEN 0 THEN 'mov eax, ' || event_id ELSE 'ret' END AS instruction, 'f' || event_id AS function_name
FROM events, (SELECT unnest([0, 1])::INTEGER AS line)""")
def representation_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    files = v.read(spark, sf, "events").select("event_id", F.concat(F.lit("Function Name: f"), n, F.lit("\nArchitecture: x86_64\nEntry Point: 0x10\ncode:\n0x10: mov eax, "), n, F.lit("\n0x12: ret\n")).alias("content"))
    return disassembly.code_lines(disassembly.parse_representation(files)).select("event_id", "line", "address", "instruction", "function_name")


# prompts, responses, batches

_PROMPTS = ", ".join(f"({v._q(k)}, {v._q(a)}, {v._q(b)})" for k, (a, b) in text.prompts().items())


@query(f"""SELECT doc_id, custom_id, path, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM (SELECT d.doc_id, printf('%s_file_%04d', 'a/b:c', d.doc_id) AS custom_id,
'out/a_b_c/' || p.ir || '/' || d.source || '/' || d.doc_id || '.c' AS path, p.a || d.text || p.b AS prompt
FROM (SELECT *, CASE lang WHEN 'en' THEN 'asm' WHEN 'fr' THEN 'llil' WHEN 'de' THEN 'mlil' ELSE 'hlil' END AS ir FROM documents) d JOIN (VALUES {_PROMPTS}) p(ir, a, b) ON d.ir = p.ir)""")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    ir = F.when(F.col("lang") == "en", "asm").when(F.col("lang") == "fr", "llil").when(F.col("lang") == "de", "mlil").otherwise("hlil")
    model = F.lit("a/b:c")
    files = v.read(spark, sf, "documents").select("doc_id", ir.alias("ir"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ir).alias("relative"), F.col("text").alias("content"))
    out = text.build_prompts(files.withColumn("kind", F.col("ir")))
    return out.select(
        "doc_id", text.custom_id(model, F.col("doc_id")).alias("custom_id"), text.result_path(F.lit("out"), model, F.concat(F.lit("."), F.col("kind")), F.col("relative")).alias("path"),
        F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"),
    )


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""SELECT conv_id, turn, trim(CASE WHEN ends_with(b, '```') THEN left(b, length(b) - 3) ELSE b END, {_WS}) AS cleaned FROM (
SELECT *, CASE WHEN starts_with(s, '```') AND contains(s, chr(10)) THEN substr(s, strpos(s, chr(10)) + 1) ELSE s END AS b FROM (SELECT *, trim(response, {_WS}) AS s FROM v_responses))""")
def llm_response_clean(spark: SparkSession, sf: str) -> DataFrame:
    return v.responses(spark, sf).select("conv_id", "turn", text.clean_response(F.col("response")).alias("cleaned"))


_RESULTS = """(SELECT r.*, coalesce(r.error, '') <> '' OR coalesce(r.response, '') = '' OR e.event_id IS NULL AS failed,
r.input_tokens + r.output_tokens AS total_tokens FROM v_results r LEFT JOIN events e ON 'm_file_' || e.event_id = r.custom_id)"""


@query(f"SELECT custom_id, provider, response, error, failed, input_tokens, output_tokens, total_tokens FROM {_RESULTS}")
def batch_results_standardize(spark: SparkSession, sf: str) -> DataFrame:
    return batch.join_requests(batch.standard_results(v.batch_lines(spark, sf)), v.requests(spark, sf))


@query(f"""SELECT provider, count(*) AS n_results, count(*) FILTER (failed) AS n_failed, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens
FROM {_RESULTS} GROUP BY provider""")
def batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    return batch.batch_counts(batch.join_requests(batch.standard_results(v.batch_lines(spark, sf)), v.requests(spark, sf)))


@query("""SELECT provider, status, CASE provider WHEN 'openai' THEN CASE WHEN status IN ('validating', 'in_progress', 'finalizing') THEN 'in_progress' WHEN status IN ('completed', 'expired') THEN 'completed' WHEN status = 'failed' THEN 'failed' WHEN status IN ('cancelling', 'cancelled') THEN 'cancelled' ELSE 'unknown' END
ELSE CASE status WHEN 'in_progress' THEN 'in_progress' WHEN 'ended' THEN 'completed' WHEN 'failed' THEN 'failed' WHEN 'expired' THEN 'failed' WHEN 'canceled' THEN 'cancelled' ELSE 'unknown' END END AS standard, count(*) AS n
FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, ['validating', 'in_progress', 'finalizing', 'completed', 'expired', 'failed', 'cancelling', 'cancelled', 'ended', 'canceled', 'odd'][event_id % 11 + 1] AS status FROM events) GROUP BY ALL""")
def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    names = ["validating", "in_progress", "finalizing", "completed", "expired", "failed", "cancelling", "cancelled", "ended", "canceled", "odd"]
    e = v.read(spark, sf, "events").select(F.when(F.expr("user_id % 2 = 0"), "openai").otherwise("anthropic").alias("provider"), v._pick(names, "event_id % 11").alias("status"))
    return e.groupBy("provider", "status").agg(F.count("*").alias("n")).withColumn("standard", batch.batch_status(F.col("provider"), F.col("status")))


@query("""SELECT event_id, provider, CASE provider WHEN 'openai' THEN a + b + 7 ELSE a + b + c + 3 END AS total, a AS completed, b AS failed, CASE provider WHEN 'openai' THEN 7 ELSE c END AS processing
FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'openai' ELSE 'anthropic' END AS provider, event_id % 11 AS a, event_id % 5 AS b, event_id % 3 AS c FROM events)""")
def batch_progress(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lambda **named: F.create_map(*(x for k, c in named.items() for x in (F.lit(k), F.expr(c).cast("long"))))
    first = pairs(total="event_id % 11 + event_id % 5 + 7", completed="event_id % 11", failed="event_id % 5")
    second = pairs(processing="event_id % 3", succeeded="event_id % 11", errored="event_id % 5", canceled="1", expired="2")
    e = v.read(spark, sf, "events").select("event_id", F.when(F.expr("user_id % 2 = 0"), "openai").otherwise("anthropic").alias("provider"))
    counts = F.when(F.col("provider") == "openai", first).otherwise(second)
    return e.select("event_id", "provider", batch.progress(F.col("provider"), counts).alias("p")).select("event_id", "provider", "p.*")


@query("""SELECT model, provider, reasoning, count(*) AS n FROM (SELECT model, CASE WHEN contains(model, 'gpt') OR contains(lower(model), 'openai') OR contains(model, 'o4') THEN 'openai' WHEN contains(model, 'claude') OR contains(lower(model), 'anthropic') THEN 'anthropic' ELSE 'openai' END AS provider,
regexp_matches(model, '(?i)o1|o3') AS reasoning FROM (SELECT ['gpt-4o', 'OpenAI/x', 'o4-mini', 'o3', 'claude-x', 'Anthropic.y', 'Claude', 'llama'][event_id % 8 + 1] AS model FROM events)) GROUP BY ALL""")
def model_routing(spark: SparkSession, sf: str) -> DataFrame:
    names = ["gpt-4o", "OpenAI/x", "o4-mini", "o3", "claude-x", "Anthropic.y", "Claude", "llama"]
    e = v.read(spark, sf, "events").select(v._pick(names, "event_id % 8").alias("model"))
    return e.groupBy("model").agg(F.count("*").alias("n")).select("model", text.provider(F.col("model")).alias("provider"), text.is_reasoning(F.col("model")).alias("reasoning"), "n")


@query("SELECT i // 100 * 100 AS range_start, max(i) + 1 AS range_end, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) GROUP BY 1")
def batch_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return batch.range_table(distribution.global_index(v.read(spark, sf, "documents").select("doc_id"), "doc_id"), "index")


@query("""SELECT model, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, count(*) AS total, count(*) FILTER (s = 'completed') = count(*) AS ok FROM (
SELECT 'm' || user_id % 5 AS model, CASE WHEN user_id % 5 = 4 OR event_type IN ('view', 'purchase') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'pending' END AS s FROM events) GROUP BY model""")
def range_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events").withColumn("model", F.concat(F.lit("m"), F.expr("user_id % 5")))
    status = F.when((F.col("model") == "m4") | F.col("event_type").isin("view", "purchase"), "completed").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return batch.range_progress(e.select("model", status.alias("status")))


@query("""SELECT 'm' || user_id % 5 AS model, event_id AS start, CASE WHEN done THEN 'completed' WHEN event_type = 'error' THEN CASE WHEN tries >= 3 THEN 'failed' ELSE 'pending' END WHEN event_type = 'purchase' THEN 'completed' ELSE 'pending' END AS status, CASE WHEN event_type = 'error' AND NOT done THEN tries ELSE tries - 1 END AS retries
FROM (SELECT *, user_id % 3 = 0 AS done, CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN event_id % 4 ELSE 0 END + 1 AS tries FROM events)""")
def range_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events").withColumn("model", F.concat(F.lit("m"), F.expr("user_id % 5")))
    state = e.select(
        "model", F.when(F.expr("user_id % 2 = 0"), "now").otherwise("before").alias("session_id"), F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"),
        F.when(F.expr("user_id % 3 = 0"), "completed").otherwise("pending").alias("status"), F.lit(None).cast("string").alias("batch_id"), F.expr("event_id % 4").alias("retries"),
    )
    told = e.where("event_type in ('error', 'purchase')").select("model", F.col("event_id").alias("start"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.lit("b").alias("batch_id"))
    return batch.advance(state, told, "now").select("model", "start", "status", F.col("retries").cast("long").alias("retries"))


@query("""SELECT conv_id, turn, md5('user:' || coalesce(lag(text) OVER w, '') || '|assistant:' || text || '|user:' || coalesce(lead(text) OVER w, '')) AS told FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def crafted_histories(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = v.read(spark, sf, "conversations").select("conv_id", "turn", "text", F.coalesce(F.lag("text").over(w), F.lit("")).alias("a"), F.coalesce(F.lead("text").over(w), F.lit("")).alias("b"))
    messages = text.append_message(text.history(F.col("a"), F.col("text")), F.col("b"))
    told = F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return t.select("conv_id", "turn", F.md5(told.cast("binary")).alias("told"))


@query("""SELECT conv_id, count(*) AS n_messages, array_to_string(list(role || ':' || length(text) ORDER BY turn, role, text), ' ') AS history FROM conversations GROUP BY conv_id""")
def conversation_history(spark: SparkSession, sf: str) -> DataFrame:
    """Texts are put in order by a sort that can spill; arrays hold their lengths."""
    t = v.read(spark, sf, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    told = F.concat("role", F.lit(":"), F.length("text").cast("string"))
    rows = t.select("conv_id", place.alias("place"), told.alias("told"))
    turns = F.array_sort(F.collect_list(F.struct("place", "told")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), turns.alias("h")).select("conv_id", "n_messages", F.array_join(F.transform("h", lambda x: x["told"]), " ").alias("history"))


# tests, logs, work

_TESTS = "(SELECT l_orderkey AS fn, l_linenumber AS i, l_extendedprice AS expected, CASE WHEN l_orderkey % 7 = 0 AND l_linenumber % 2 = 0 THEN l_extendedprice + 1 WHEN l_orderkey % 5 = 0 THEN l_extendedprice * (1 + 1e-11) ELSE l_extendedprice END AS observed FROM lineitem)"
_RATES = f"(SELECT fn, count(*) FILTER (abs(observed - expected) <= 1e-9 * greatest(abs(observed), abs(expected))) AS successes, count(*) AS total FROM {_TESTS} GROUP BY fn)"


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    t = v.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_linenumber").alias("i"), F.col("l_extendedprice").alias("expected"))
    observed = F.when(F.expr("fn % 7 = 0 and i % 2 = 0"), F.col("expected") + 1).when(F.expr("fn % 5 = 0"), F.col("expected") * (1 + 1e-11)).otherwise(F.col("expected"))
    t = t.withColumn("observed", observed)
    box = lambda c: F.create_map(F.lit("v"), F.col(c))
    return t.withColumn("passed", verify.same_flat(box("observed"), box("expected")))


@query(f"SELECT fn, successes, total, round(successes / total * 100, 6) AS pct, successes = total AS all_passed FROM {_RATES}")
def io_pair_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    return verify.pass_rates(_tests(spark, sf), ["fn"]).withColumn("pct", F.round("pct", 6))


@query(f"SELECT count(*) FILTER (successes = total) AS fully_passed, count(*) AS n_functions, round(count(*) FILTER (successes = total) / count(*) * 100, 6) AS success_rate FROM {_RATES}")
def overall_success_rate(spark: SparkSession, sf: str) -> DataFrame:
    return verify.overall_rate(verify.pass_rates(_tests(spark, sf), ["fn"])).withColumn("success_rate", F.round("success_rate", 6))


# pairs of JSON texts, # standing for a number of the row
_JSON_PAIRS = [
    ("#", "#.0"), ("true", "1"), ("#.5", "#.50000000001"), ("#.5", "#.6"), ("[#,2]", "[#]"), ("[#,2]", "[#,2]"), ("[#,2]", "[2,#]"), ("{}", '{"a":#}'), ('{"a":#}', "{}"), ('{"a":#}', '{"a":#,"b":1}'),
    ('{"a":#,"b":1}', '{"b":2,"a":#}'), ("NaN", "NaN"), ("null", "null"), ('"#"', '"#"'), ('"#"', "#"), ("-#", "#"),
]
_PAIRS_SQL = ", ".join(f"({i}, {v._q(o)}, {v._q(x)})" for i, (o, x) in enumerate(_JSON_PAIRS))
_KIND = "CASE json_type({0}) WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type({0}) END"


@query(f"""SELECT event_id, CASE WHEN NOT json_valid(o) OR NOT json_valid(x) THEN false WHEN {_KIND.format('o')} <> {_KIND.format('x')} THEN false
WHEN json_type(o) = 'DOUBLE' THEN NOT isnan(o::DOUBLE) AND abs(o::DOUBLE - x::DOUBLE) <= 1e-9 * greatest(abs(o::DOUBLE), abs(x::DOUBLE))
WHEN json_type(o) = 'ARRAY' THEN json_array_length(o) = json_array_length(x) AND len(list_filter(range(json_array_length(o)::BIGINT), lambda i: json_extract(o, '$[' || i || ']') <> json_extract(x, '$[' || i || ']'))) = 0
WHEN json_type(o) = 'OBJECT' THEN len(list_filter(json_keys(o), lambda k: NOT coalesce(json_extract(o, '$.' || k) = json_extract(x, '$.' || k), false))) = 0
ELSE o = x END AS same FROM (SELECT event_id, replace(p.o, '#', (event_id + 1)::VARCHAR) AS o, replace(p.x, '#', (event_id + 1)::VARCHAR) AS x FROM events JOIN (VALUES {_PAIRS_SQL}) p(i, o, x) ON event_id % {len(_JSON_PAIRS)} = p.i)""")
def deep_output_comparison(spark: SparkSession, sf: str) -> DataFrame:
    n = F.expr("cast(event_id + 1 as string)")
    given = lambda k: F.replace(v._pick([p[k] for p in _JSON_PAIRS], f"event_id % {len(_JSON_PAIRS)}"), F.lit("#"), n)
    e = v.read(spark, sf, "events").select("event_id", given(0).alias("o"), given(1).alias("x"))
    return deep_compare.with_same(e, "o", "x").select("event_id", "same")


_NL = "' || chr(10) || '"


@query(f"""SELECT fn, 'Function: f' || fn || '{_NL}Binary: ' || fn || '.o{_NL}Tests: ' || successes || '/' || total || ' passed (' || printf('%.1f', successes / total * 100) || '%){_NL}' ||
CASE WHEN successes = total THEN 'Status: ALL TESTS PASSED ✓{_NL}' ELSE 'Status: SOME TESTS FAILED ✗{_NL}{_NL}Failed tests:{_NL}' || lines || '{_NL}' END AS report FROM (SELECT fn, count(*) FILTER (ok) AS successes, count(*) AS total,
array_to_string(list('  - Test ' || i || ': differs' ORDER BY i) FILTER (NOT ok), chr(10)) AS lines FROM (SELECT *, abs(observed - expected) <= 1e-9 * greatest(abs(observed), abs(expected)) AS ok FROM {_TESTS}) GROUP BY fn)""")
def test_report_text(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct("i", F.concat(F.lit("Test "), F.col("i").cast("string"), F.lit(": differs")).alias("t"))
    own = _tests(spark, sf).groupBy("fn").agg(F.count_if("passed").alias("successes"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~F.col("passed"), line))).alias("f"))
    n = F.col("fn").cast("string")
    report = verify.report_text(F.concat(F.lit("f"), n), F.concat(n, F.lit(".o")), F.col("successes"), F.col("total"), F.transform("f", lambda x: x["t"]))
    return own.select("fn", report.alias("report"))


@query(f"""SELECT event_id, 'Function: f' || event_id || '{_NL}Binary: ' || event_id || '.o{_NL}Status: COMPILATION/EXECUTION ERROR ✗{_NL}Error: ' || coalesce(props, '') || '{_NL}' AS report FROM events""")
def test_error_report(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    report = verify.error_report_text(F.concat(F.lit("f"), n), F.concat(n, F.lit(".o")), F.coalesce("props", F.lit("")))
    return v.read(spark, sf, "events").select("event_id", report.alias("report"))


@query("""SELECT file, regexp_extract(content, '(?m)^Function: (.*)$', 1) AS fname, nullif(regexp_extract(content, '(?m)^Tests: ([0-9]+)/([0-9]+) passed', 1), '')::INTEGER AS successes,
nullif(regexp_extract(content, '(?m)^Tests: ([0-9]+)/([0-9]+) passed', 2), '')::INTEGER AS total, regexp_extract(content, '(?m)^Status: ([A-Z/ ]*[A-Z])', 1) AS status,
len(regexp_extract_all(content, '(?m)^  - Test [0-9]+: ')) AS n_failed_lines FROM v_exec_reports""")
def test_report_parse(spark: SparkSession, sf: str) -> DataFrame:
    return verify.parse_report(v.exec_reports(spark, sf)).select("file", "fname", "successes", "total", "status", "n_failed_lines")


@query("""SELECT split_part(value, '|', 1) AS status, split_part(value, '|', 2) AS type, count(*) AS n, count(*) FILTER (value LIKE '%left|right') AS n_piped, max(split_part(value, '|', 5)) AS last_stamp FROM v_log_lines GROUP BY ALL""")
def patch_log_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_log_lines(v.log_lines(spark, sf))
    return rows.groupBy("status", "type").agg(F.count("*").alias("n"), F.count_if(F.col("details") == "left|right").alias("n_piped"), F.max("timestamp").alias("last_stamp"))


_PATH = "source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.c'"


@query(f"SELECT doc_id, ntile(8) OVER (ORDER BY string_split({_PATH}, '/'))::INTEGER AS worker FROM documents")
def work_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".c")).alias("path"))
    return distribution.shares(rows, "path", 8).select("doc_id", "worker")


def _worker_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Files of three workers, one document each: path, worker, content."""
    d = v.read(spark, sf, "documents")
    return d.select(F.concat(F.lit("d/"), F.expr("doc_id div 3").cast("string"), F.lit(".txt")).alias("path"), F.expr("cast(doc_id % 3 as int)").alias("worker"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text", F.lit("\n")).alias("content"))


@query("""SELECT path, string_agg(content, '' ORDER BY worker, content) AS content, count(*)::INTEGER AS n_workers FROM (SELECT 'd/' || doc_id // 3 || '.txt' AS path, (doc_id % 3)::INTEGER AS worker, doc_id || ':' || text || chr(10) AS content FROM documents) GROUP BY path""")
def merge_worker_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return distribution.merge_outputs(_worker_outputs(spark, sf))


@query("SELECT url, regexp_replace(url, '\\.[^./]*$', '.txt') AS result_path, replace(replace(url, '/', '_'), chr(92), '_') AS safe FROM pages")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return v.read(spark, sf, "pages").select("url", text.with_extension(u, ".txt").alias("result_path"), text.safe_name(u).alias("safe"))


# files written from the tables and read back


@query("SELECT doc_id AS id, text AS func_def, lang AS fname FROM documents")
def corpus_from_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as corpus lines: written, and read by the lenient reader."""
    path = f"{scratch(spark)}/corpus"
    sinks.write_jsonl(v.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("func_def"), F.col("lang").alias("fname")), path)
    return readers.good_rows(readers.read_jsonl(spark, path)).select("id", "func_def", "fname")


@query("SELECT doc_id AS id, text AS func_def, lang AS fname FROM documents")
def corpus_from_strict_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch(spark)}/corpus"
    sinks.write_jsonl(v.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("func_def"), F.col("lang").alias("fname"), F.lit("x").alias("asm")), path)
    return readers.read_jsonl_strict(spark, path).select("id", "func_def", "fname")


@query("SELECT p_brand AS id, max_by(p_name, p_partkey) AS func_def FROM part GROUP BY p_brand")
def last_of_each_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.read(spark, sf, "part").select(F.col("p_brand").alias("id"), F.col("p_name").alias("func_def"), F.col("p_partkey").alias("line_num"))
    return readers.last_by(rows, "id", "line_num").select("id", "func_def")


@query(f"SELECT iteration, model, ir, opt, category, subcategory, file FROM {_sql_compile()}")
def organised_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Labels below folders of iteration, category and subcategory, read back."""
    levels = ["iteration", *rollup.LABEL]
    rows, path = _compile_labels(spark, sf).select(*levels, *rollup.CONFIG, "file"), f"{scratch(spark)}/tree"
    sinks.write_tree(rows, path, levels)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("""SELECT split_part(value, '|', 1) AS status, split_part(value, '|', 2) AS type, split_part(value, '|', 3) AS file, split_part(value, '|', 5) AS timestamp, CASE WHEN value LIKE '%left|right' THEN 'left|right' ELSE 'done' END AS details FROM v_log_lines""")
def streamed_log_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event log lines as a stream of files, worked off to Parquet."""
    root = scratch(spark)
    v.log_lines(spark, sf).write.text(f"{root}/in")
    events = ingest.log_stream(spark, f"{root}/in").select("status", "type", "file", "timestamp", "details")
    ingest.run_available(events, f"{root}/out", f"{root}/at").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out")


# what scripts leave out, and texts that they put together


@query("SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 7 <> 0 THEN event_id % 5 = 0 END, false) = false AND event_id % 11 <> 0")
def own_functions(spark: SparkSession, sf: str) -> DataFrame:
    e = v.read(spark, sf, "events").select("event_id", F.expr("if(event_id % 7 <> 0, event_id % 5 = 0, null)").alias("is_plt"), F.expr("event_id % 11 = 0").alias("is_simprocedure"))
    return disassembly.own_functions(e).select("event_id")


@query("SELECT line_num, 'empty func_def' AS error FROM v_corpus_lines WHERE func_def = ''")
def undefined_functions(spark: SparkSession, sf: str) -> DataFrame:
    return disassembly.split_undefined(v.corpus_lines(spark, sf))[1].select("line_num", "error")


@query("SELECT line_num, length(func_def) AS n_chars FROM v_corpus_lines WHERE func_def <> ''")
def files_with_content(spark: SparkSession, sf: str) -> DataFrame:
    return disassembly.split_empty(v.corpus_lines(spark, sf), "func_def")[0].select("line_num", F.length("func_def").cast("long").alias("n_chars"))


@query("""SELECT 'f' || l_orderkey AS name, string_agg('block ' || l_linenumber || ' ' || l_partkey, chr(10) ORDER BY l_linenumber * 7919 % 8191, 'block ' || l_linenumber || ' ' || l_partkey) AS content FROM lineitem GROUP BY l_orderkey""")
def function_listings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber").cast("string")
    start = F.concat(F.lit("0x"), F.lower(F.hex(F.expr("l_linenumber * 7919 % 8191"))))
    blocks = v.read(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("name"), start.alias("start"), F.concat(F.lit("block "), n, F.lit(" "), F.col("l_partkey").cast("string")).alias("text"))
    return disassembly.listing(blocks)


@query("""SELECT url, left(url, length(url) - length(ext)) || '_m' || '_response' || ext AS path FROM (SELECT url, regexp_extract(url, '[^/]([.][^./]*)$', 1) AS ext FROM pages)""")
def legacy_paths(spark: SparkSession, sf: str) -> DataFrame:
    return v.read(spark, sf, "pages").select("url", text.legacy_path(F.col("url"), F.lit("m")).alias("path"))


_HARNESS = ['extern "C" {' + chr(10) + '#include "/tmp/x', '.c"' + chr(10) + '}' + chr(10) + '#include "f', '.c"' + chr(10) + '#include <stdio.h>' + chr(10) + 'int main() { return ', '; }']


@query(f"""SELECT event_id, coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, '') || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(h, {v._q(text.SOURCE_INCLUDES[0])}, '', 'g'), {v._q(text.SOURCE_INCLUDES[1])}, '', 'g'), {v._q(text.SOURCE_INCLUDES[2])}, '', 'g') AS source
FROM (SELECT event_id, event_type, {v._q(_HARNESS[0])} || event_id || {v._q(_HARNESS[1])} || event_id || {v._q(_HARNESS[2])} || event_id || {v._q(_HARNESS[3])} AS h FROM events)""")
def harness_sources(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    harness = F.concat(F.lit(_HARNESS[0]), n, F.lit(_HARNESS[1]), n, F.lit(_HARNESS[2]), n, F.lit(_HARNESS[3]))
    deps = F.when(F.expr("event_id % 3 <> 0"), F.col("event_type"))
    return v.read(spark, sf, "events").select("event_id", text.assemble_source(deps, text.strip_source_includes(harness)).alias("source"))


def exact_picks(sizes: dict, cap: int = sampling.CAP, seed: int = sampling.SEED) -> dict:
    """Places per bucket as the sampler draws them; for tests."""
    generator = random.Random(seed)
    return {b: list(range(sizes[b])) if sizes[b] < cap else generator.sample(range(sizes[b]), cap) for b in sorted(sizes)}

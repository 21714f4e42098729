"""Software-complexity (Halstead) metrics of C code as columns, and the same as SQL text for DuckDB.

Counting follows a plain lexer-free scheme: comments and the contents of literals are removed in a fixed order, then every
operator is counted on its own (so "<<=" counts as "<<", "<", "<=" and "="), keywords count as operators, and identifiers,
numbers and the two kinds of literals count as operands. Words are runs of letters, digits and underscores of any script; a
run counts as an identifier only if it is ASCII and does not begin with a digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operators and C89 keywords.
OPERATORS = [
    "++", "--", "+", "-", "*", "/", "%", "=", "+=", "-=", "*=", "/=", "%=", "==", "!=", "<=", ">=", "<", ">",
    "&&", "||", "!", "&", "|", "^", "~", "<<", ">>", "?", ":", ";", ",", "(", ")", "{", "}", "[", "]",
]
KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "int", "long", "register", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void",
    "volatile", "while",
]
#: Removals in their order: line comments, block comments, contents of string and character literals.
REMOVALS = [("//[^\n]*", ""), (r"(?s)/\*.*?\*/", ""), ('"[^"]*"', '""'), ("'[^']*'", "''")]
RUN = r"[\p{L}\p{N}_]+"
#: Ends of a run.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
NUMBER = r"\b[0-9]+(?:\.[0-9]+)?\b"
#: NUMBER with letters and digits of any script as parts of words; it looks around at digits only.
NUMBER_JAVA = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]+(?:\.[0-9]+)?(?![\p{L}\p{N}_])"
LITERALS = [('""', "string_literal"), ("''", "char_literal")]

#: Runs without a sign of an operator or a literal; one space for each leaves a short text with the same counts of signs.
OTHER = r"""[^-+*/%=!<>&|^~?:;,(){}\[\]"']+"""

COUNTS = ["n1_distinct", "n1_total", "n2_distinct", "n2_total"]


def clean_code(code: Column) -> Column:
    for pattern, to in REMOVALS:
        code = F.regexp_replace(code, pattern, to)
    return code


def _occurrences(text: Column, literal: str) -> Column:
    cut = F.octet_length(F.replace(text, F.lit(literal), F.lit("")))  # literals are ASCII, and a count of bytes is at hand
    return ((F.octet_length(text) - cut) / len(literal)).cast("int")


def with_counts(df: DataFrame, code: str) -> DataFrame:
    """Adds n1_distinct, n1_total (operators) and n2_distinct, n2_total (operands); null for null or empty code. Each costly
    step is a column of its own, and the counts come out of a generator, below which no later filter is pushed, so no
    expression is evaluated twice."""
    words = df.withColumn("_clean", clean_code(F.nullif(F.col(code), F.lit(""))))
    words = words.withColumn("_signs", F.regexp_replace("_clean", OTHER, " "))
    words = words.select(
        "*", F.regexp_extract_all("_clean", F.lit(f"{BEFORE}[A-Za-z_][A-Za-z0-9_]*{AFTER}"), 0).alias("_words"),
        F.regexp_extract_all("_clean", F.lit(NUMBER_JAVA), 0).alias("_numbers"),
        F.array(*(_occurrences(F.col("_signs"), op) for op in OPERATORS)).alias("_ops"),
        F.array(*(_occurrences(F.col("_signs"), lit) for lit, _ in LITERALS)).alias("_literals"),
    )
    words = words.withColumn("_keywords", F.size(F.filter("_words", lambda w: w.isin(KEYWORDS))))
    keywords = F.array(*(F.lit(k) for k in KEYWORDS))
    n1 = F.size(F.filter("_ops", lambda x: x > 0)) + F.size(F.array_intersect("_words", keywords))
    total1 = F.aggregate("_ops", F.lit(0), lambda a, x: a + x) + F.col("_keywords")
    n2 = F.size(F.array_except("_words", keywords)) + F.size(F.array_distinct("_numbers"))
    total2 = F.size("_words") - F.col("_keywords") + F.size("_numbers")
    for i, (_, name) in enumerate(LITERALS):
        held = F.col("_literals")[i]
        same = F.size("_words") - F.size(F.array_remove("_words", name))
        # a literal's count replaces that of an identifier which has its name
        n2 = n2 + F.when((held > 0) & (same == 0), 1).otherwise(0)
        total2 = total2 + F.when(held > 0, held - same).otherwise(0)
    known = F.col("_clean").isNotNull()
    counts = F.struct(*(F.when(known, x).cast("long").alias(n) for n, x in zip(COUNTS, (n1, total1, n2, total2), strict=True)))
    return words.select(*df.columns, F.inline(F.array(counts)))


def with_metrics(df: DataFrame, code: str) -> DataFrame:
    """Adds the counts, vocabulary, program_length, volume, difficulty and effort (unrounded doubles)."""
    out = with_counts(df, code)
    vocabulary, length = F.col("n1_distinct") + F.col("n2_distinct"), F.col("n1_total") + F.col("n2_total")
    volume = F.when(F.col("vocabulary") > 1, F.col("program_length") * F.log2(F.col("vocabulary").cast("double"))).when(F.col("vocabulary").isNotNull(), 0.0)
    difficulty = F.when(F.col("n2_distinct") > 0, (F.col("n1_distinct") / 2) * (F.col("n2_total") / F.col("n2_distinct"))).when(F.col("n2_distinct").isNotNull(), 0.0)
    out = out.withColumn("vocabulary", vocabulary).withColumn("program_length", length)
    out = out.withColumn("volume", volume).withColumn("difficulty", difficulty)
    return out.withColumn("effort", F.col("difficulty") * F.col("volume"))


def difficulty_bucket(difficulty: Column) -> Column:
    return F.ceil(difficulty).cast("int")


def bucket_label(bucket: Column, *, academic: bool = True) -> Column:
    """The range of a bucket as reports print it; the academic form has a stray "..1" that is part of the format."""
    low = F.greatest(bucket - 1, F.lit(0)).cast("double")
    return F.format_string("%.1f...1-%.1f" if academic else "%.1f-%.1f", low, bucket.cast("double"))


# SQL text


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_counts(source: str, key: str, code: str) -> str:
    """DuckDB SQL for a relation with the key and the counts."""
    clean = f"nullif({code}, '')"
    for pattern, to in REMOVALS:
        clean = f"regexp_replace({clean}, {_q(pattern)}, {_q(to)}, 'g')"
    kw = ", ".join(_q(k) for k in KEYWORDS)
    times = lambda lit: f"(length(c) - length(replace(c, {_q(lit)}, ''))) // {len(lit)}"
    ops = ", ".join(times(op) for op in OPERATORS)
    parts = {"s": LITERALS[0], "h": LITERALS[1]}
    same = lambda name: f"len(list_filter(names, lambda w: w = {_q(name)}))"
    extra2 = " + ".join(f"(CASE WHEN {k} > 0 AND {same(n)} = 0 THEN 1 ELSE 0 END)" for k, (_, n) in parts.items())
    total2 = " + ".join(f"(CASE WHEN {k} > 0 THEN {k} - {same(n)} ELSE 0 END)" for k, (_, n) in parts.items())
    return f"""
SELECT {key},
  len(list_filter(ops, lambda x: x > 0)) + len(list_distinct(keywords)) AS n1_distinct,
  list_sum(ops)::BIGINT + len(keywords) AS n1_total,
  len(list_distinct(names)) + len(list_distinct(numbers)) + {extra2} AS n2_distinct,
  len(names) + len(numbers) + {total2} AS n2_total
FROM (SELECT *, list_filter(words, lambda w: w IN ({kw})) AS keywords, list_filter(words, lambda w: w NOT IN ({kw})) AS names FROM (
  SELECT {key}, [{ops}] AS ops, {times(LITERALS[0][0])} AS s, {times(LITERALS[1][0])} AS h,
    list_filter(regexp_extract_all(c, {_q(RUN)}), lambda w: regexp_matches(w, {_q(IDENTIFIER)})) AS words,
    regexp_extract_all(regexp_replace(c, '[\\p{{L}}_]', 'z', 'g'), {_q(NUMBER)}) AS numbers
  FROM (SELECT {key}, {clean} AS c FROM {source})))
"""


SQL_DIFFICULTY = "CASE WHEN n2_distinct > 0 THEN (n1_distinct / 2) * (n2_total / n2_distinct) ELSE 0.0 END"

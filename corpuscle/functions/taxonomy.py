"""Multi-label taxonomies of compiler diagnostics and test reports.

Per category, in order, a text gets the first subcategory that has a pattern found in it (ignoring case), so up to one label a
category; a text without any gets one default label. The tables are data: one list makes the Spark columns and the SQL text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of compile errors, version "detailed".
COMPILE_DETAILED: dict[str, dict[str, list[str]]] = {
    "syntax": {
        "missing_syntax_elements": ["expected ';' before", "missing ';'", "expected .* before", "expected .* at end"],
        "malformed_expression": ["expected expression before", "expected primary-expression", "syntax error before"],
        "invalid_statement": ["expected statement", "invalid use of", "statement not within a loop", "break statement not within", "without a previous", "computed goto must be pointer type", "is a pointer; did you mean to use", "exponent has no digits"],
        "parse_error": ["parse error", "syntax error at end of input"],
        "invalid_suffix": ["invalid suffix"],
        "invalid_literal": ["hexadecimal floating constants require an exponent", "invalid or incomplete multibyte or wide character"],
    },
    "declaration": {
        "undeclared_variable": [r"undeclared \(first use", "was not declared", "error: .* undeclared"],
        "undeclared_function": ["implicit declaration of function", "undeclared.*function"],
        "multiple_definition": ["redefinition of", "multiple definition of", "redeclared as different kind of symbol", "duplicate label", "redeclaration of", "function definition declared"],
        "missing_prototype": ["conflicting types for", "previous declaration"],
        "invalid_declaration": ["expected declaration", "declaration does not declare", "initializer element is not constant", "label .* used but not defined", "built-in function .* must be directly called"],
        "unknown_type": ["unknown type name", "error: unknown type name"],
    },
    "type": {
        "incompatible_assignment": ["assignment from incompatible pointer type", "incompatible types when assigning", "assignment to expression with array type", "assignment of read-only variable"],
        "incompatible_initialization": ["initialization from incompatible pointer type", "incompatible types when initializing"],
        "invalid_operands": ["invalid operands to binary", "array subscript is not an integer"],
        "invalid_conversion": ["cannot convert", "invalid conversion", "non-floating-point arguments in call to function", "invalid initializer", "onversion of scalar"],
        "pointer_mismatch": ["dereferencing pointer to incomplete type", "invalid type argument", "in something not a structure or union", "lvalue required as unary", "lvalue required as left operand of assignment", "has no member named", "called object .* is not a function or function pointer", "void value not ignored as it ought to be", "lvalue required as increment operand", "value used where a .* was expected", "assignment of read-only location", "cast from pointer to integer of different size", "cast specifies array type", "array type has incomplete element type", "irst argument must be an integer or floating vector"],
        "type_mismatch": ["incompatible type for argument", "too few arguments to function", "too many arguments to function", "incompatible types when returning", "non-floating-point argument in call to function", "used vector type where scalar is required", "cast to pointer from integer of different size", "must be an integer constant", "does not reduce to an integer constant", "where an integer was expected", "used where a .* where .* was expected", "matching constraint references invalid operand number", "conflicting type qualifiers"],
    },
    "preprocessing": {
        "missing_include": [r"fatal error: .*\.h: No such file", r".*\.h: No such file or directory"],
        "file_not_found": ["No such file or directory", "cannot open include file"],
        "macro_error": ["macro .* redefined", "unterminated #if", "invalid preprocessing directive"],
        "include_error": ["#include expects", "error in #include", "called object is not a function or function pointer"],
    },
    "linker": {
        "undefined_reference": ["undefined reference to", "unresolved external symbol"],
        "missing_library": ["cannot find -l", "library not found"],
        "linker_failure": ["ld returned .* exit status", "collect2: error: ld returned"],
        "symbol_error": ["multiple definition of", "first defined here"],
    },
    "architecture": {
        "isa_requirements": ["needs isa option", "__builtin_.* needs isa option"],
        "assembly_error": ["operand size mismatch for", "operand type mismatch for", "inconsistent operand constraints", "internal compiler error", "invalid register name", "operand has impossible constraints", "cannot be used in .*asm", "invalid .*asm", "bad register name", "register type mismatch for"],
        "target_mismatch": ["target specific option mismatch", "inlining failed.*always_inline.*option mismatch", "subscripted value is neither array nor pointer nor vector"],
    },
}
# Where version "consolidated" differs. A subcategory's list replaces that of the detailed version; one renamed
# stands at the place of the old name.
CONSOLIDATED_RENAMED = {("declaration", "missing_prototype"): "conflicting_type"}
CONSOLIDATED_LISTS: dict[tuple[str, str], list[str]] = {
    ("syntax", "invalid_statement"): [*COMPILE_DETAILED["syntax"]["invalid_statement"], "value used where a .* was expected", "assignment of read-only location"],
    ("declaration", "multiple_definition"): [*COMPILE_DETAILED["declaration"]["multiple_definition"], "previous declaration"],
    ("declaration", "conflicting_type"): ["conflicting types for"],
    ("type", "incompatible_initialization"): [*COMPILE_DETAILED["type"]["incompatible_initialization"], "invalid initializer"],
    ("type", "invalid_conversion"): ["cannot convert", "invalid conversion", "non-floating-point arguments in call to function", "conversion of scalar"],
    ("type", "pointer_mismatch"): ["dereferencing pointer to incomplete type", "in something not a structure or union", "lvalue required as unary", "lvalue required as left operand of assignment", "has no member named", "called object .* is not a function or function pointer", "void value not ignored as it ought to be", "lvalue required as increment operand", "cast from pointer to integer of different size", "cast specifies array type", "array type has incomplete element type"],
    ("type", "type_mismatch"): ["incompatible type for argument", "too few arguments to function", "too many arguments to function", "incompatible types when returning", "non-floating-point argument in call to function", "used vector type where scalar is required", "must be an integer constant", "does not reduce to an integer constant", "where .* was expected", "matching constraint references invalid operand number", "conflicting type qualifiers", "irst argument must be an integer or floating vector"],
    ("preprocessing", "include_error"): ["#include expects", "error in #include"],
}
# The patterns of test reports; braces escaped for Java.
EXECUTION: dict[str, dict[str, list[str]]] = {
    "logic": {"wrong_logic": [r"Expected \{.*\}, Got \{.*\}$"]},
    "runtime_exceptions": {"memory_corruption": ["Exception - generator didn't stop after throw", "Exception - Expecting value: line 1 column 1"]},
    "control_flow": {"infinite_loop": ["Command.*timed out after 60 seconds$"]},
}
TEST_LINE = "^  - Test [0-9]+: (.*)$"
PASSED = "ALL TESTS PASSED"


def consolidated() -> dict[str, dict[str, list[str]]]:
    out: dict[str, dict[str, list[str]]] = {}
    for cat, subs in COMPILE_DETAILED.items():
        out[cat] = {}
        for sub, patterns in subs.items():
            name = CONSOLIDATED_RENAMED.get((cat, sub), sub)
            out[cat][name] = CONSOLIDATED_LISTS.get((cat, name), patterns)
    return out


COMPILE = {"detailed": COMPILE_DETAILED, "consolidated": consolidated()}


def _any(patterns: list[str]) -> str:
    return "|".join(dict.fromkeys(patterns))


_SPECIAL = re.compile(r"[][.^$*+?{}|()]")


def _literals(pattern: str) -> list[str] | None:
    """The texts between the ".*" of a pattern that has no other syntax; None for one that has."""
    out = []
    for piece in pattern.split(".*"):
        if _SPECIAL.search(re.sub(r"\\.", "", piece)):
            return None
        out.append(re.sub(r"\\(.)", r"\1", piece))
    return [x for x in out if x]


def found_in(content: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern occurs, ignoring case; low is the content in lower case. Plain text is looked for as such, which is many times faster than a regular
    expression; one with gaps is tried only where all its texts occur."""
    parts = _literals(pattern)
    whole = content.rlike("(?id)" + pattern)
    if parts is None:
        return whole
    held = reduce(and_, (F.contains(low, F.lit(x.lower())) for x in parts))
    return held if len(parts) == 1 else held & whole


def _firsts(content: Column, low: Column, table: dict[str, dict[str, list[str]]]) -> dict[str, Column]:
    """By category: its first subcategory that is found, or null."""
    out = {}
    for cat, subs in table.items():
        first = F
        for sub, patterns in subs.items():
            first = first.when(reduce(or_, (found_in(content, low, p) for p in dict.fromkeys(patterns))), F.lit(sub))
        out[cat] = first
    return out


def _gathered(firsts: dict[str, Column], default: tuple[str, str] | None) -> Column:
    label = lambda cat, sub: F.struct(F.lit(cat).alias("category"), sub.alias("subcategory"))
    out = F.array_compact(F.array(*(F.when(first.isNotNull(), label(cat, first)) for cat, first in firsts.items())))
    return out if default is None else F.when(F.size(out) > 0, out).otherwise(F.array(label(default[0], F.lit(default[1]))))


def labels(content: Column, table: dict[str, dict[str, list[str]]], default: tuple[str, str] | None = ("other", "unclassified")) -> Column:
    """array<struct<category, subcategory>>: the first subcategory of each category, in order; the default if there is none. Spark
    evaluates parts of it several times; `with_labels` has it once."""
    return _gathered(_firsts(content, F.lower(content), table), default)


def first_label(content: Column, table: dict[str, dict[str, list[str]]], default: tuple[str, str]) -> Column:
    """The first of labels(), without a look at the patterns after it."""
    out, low = F, F.lower(content)
    for cat, subs in table.items():
        for sub, patterns in subs.items():
            hit = reduce(or_, (found_in(content, low, p) for p in dict.fromkeys(patterns)))
            out = out.when(hit, F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory")))
    return out.otherwise(F.struct(F.lit(default[0]).alias("category"), F.lit(default[1]).alias("subcategory")))


def with_labels(files: DataFrame, content: str, table: dict[str, dict[str, list[str]]], name: str = "found") -> DataFrame:
    """Adds labels(). The lower-case text and the subcategories come out of generators, so they are made once a row: not once for every
    pattern, and not again wherever the labels are named."""
    low = files.select("*", F.explode(F.array(F.lower(content))).alias("_low"))
    firsts = F.struct(*(c.alias(cat) for cat, c in _firsts(F.col(content), F.col("_low"), table).items()))
    out = low.select("*", F.explode(F.array(firsts)).alias("_firsts"))
    return out.withColumn(name, _gathered({cat: F.col("_firsts")[cat] for cat in table}, ("other", "unclassified"))).drop("_low", "_firsts")


def test_lines(content: Column) -> Column:
    """The messages of a report's failed tests."""
    return F.regexp_extract_all(content, F.lit("(?md)" + TEST_LINE), 1)


def _line_labels(content: Column, whole: bool) -> Column:
    lines = test_lines(content)
    if whole:
        lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(content))
    return F.array_distinct(F.transform(lines, lambda line: first_label(line, EXECUTION, ("unclassified", "unclassified"))))


def _of_failed(content: Column, found: Column) -> Column:
    return F.when(~F.contains(content, F.lit(PASSED)) & (F.size(found) > 0), found)


def execution_labels(content: Column, *, whole: bool = False) -> Column:
    """The set of labels of a report: per test line the first category that matches. Null if all tests passed, and for a report
    without test lines, whose whole content is classified instead if `whole`."""
    return _of_failed(content, _line_labels(content, whole))


def with_execution_labels(reports: DataFrame, content: str, name: str = "found", *, whole: bool = False) -> DataFrame:
    """Adds execution_labels(), which come out of a generator, so that they are found once a row."""
    out = reports.select("*", F.explode(F.array(_line_labels(F.col(content), whole))).alias("_found"))
    return out.withColumn(name, _of_failed(F.col(content), F.col("_found"))).drop("_found")


def failure_type(content: Column, pairs: int = 10) -> Column:
    """allfailed if no test of `pairs` passed; a function with another number of tests counts as partialfailed."""
    return F.when(F.contains(content, F.lit(f"0/{pairs} passed (0.0%)")), F.lit("allfailed")).otherwise(F.lit("partialfailed"))


# SQL text


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_labels(content: str, table: dict[str, dict[str, list[str]]], default: tuple[str, str] = ("other", "unclassified"), end: str = "") -> str:
    """A DuckDB list of structs, as labels() makes it."""
    found = []
    for cat, subs in table.items():
        cases = " ".join(f"WHEN regexp_matches({content}, {_q('(?i)' + _any(p))}) THEN {{'category': {_q(cat)}, 'subcategory': {_q(sub)}}}" for sub, p in subs.items())
        found.append(f"CASE {cases} END")
    every = f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"
    none = f"[{{'category': {_q(default[0])}, 'subcategory': {_q(default[1])}}}]"
    return f"(CASE WHEN len({every}) > 0 THEN {every} ELSE {none} END)"


def sql_execution_labels(content: str, *, whole: bool = False) -> str:
    lines = f"regexp_extract_all({content}, {_q('(?m)' + TEST_LINE)}, 1)"
    if whole:
        lines = f"(CASE WHEN len({lines}) > 0 THEN {lines} ELSE [{content}] END)"
    label = f"list_distinct(list_transform({lines}, lambda y: {sql_labels('y', EXECUTION, ('unclassified', 'unclassified'))}[1]))"
    return f"(CASE WHEN NOT contains({content}, {_q(PASSED)}) AND len({lines}) > 0 THEN {label} END)"

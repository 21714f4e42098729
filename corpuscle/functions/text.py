"""Scalar text functions: response cleaning, prompts, identifiers, paths, addresses, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that strip() takes here: ASCII only (the scripts' own strip() also takes a few rare separators).
SPACE = " \t\n\r\x0b\x0c"

# The prompts before and after the code, by representation.
PROLOGUES = {
    "asm": """You are an expert reverse engineer. Decompile the following assembly code to equivalent C source code.
Analyze the assembly instructions, registers, memory operations, and control flow to produce functional and compilable C source code.
Assembly code to decompile:

```""",
    "llil": """You are an expert reverse engineer. Decompile the following LLIL code to equivalent C source code.
LLIL is Binary Ninja's low-level IR that abstracts away architecture-specific details while preserving low-level semantics.
Analyze the LLIL operations, memory accesses, and control structures to produce functional and compilable C source code.
LLIL code to decompile:

```""",
    "mlil": """You are an expert reverse engineer. Decompile the following MLIL code to equivalent C source code.
MLIL is Binary Ninja's medium-level IR that performs data flow analysis and eliminates many low-level artifacts.
Analyze the MLIL operations, variables, and control flow to produce functional and compilable C source code.
MLIL code to decompile:

```""",
    "hlil": """You are an expert reverse engineer. Decompile the following HLIL code to equivalent C source code.
HLIL is Binary Ninja's highest-level IR that recovers high-level constructs like loops, conditionals, and function calls.
Analyze the HLIL operations and structures to produce functional and compilable C source code.
HLIL code to decompile:

```""",
}
EPILOGUE = """```

Output format: Only C code, no explanations, no markdown formatting.
Function name: func0
Variable names: var0, var1, var2, etc.
Include necessary headers (#include) if needed.
Do not include ```c or ``` markers."""

# Includes of generated sources in a test harness.
SOURCE_INCLUDES = (
    r'extern\s+"C"\s*\{\s*#include\s+"[^"]*\.c"\s*\}',
    r'#include\s+"[^"]*\.c"',
    r'#include\s+"[^"]*(/tmp/[^"]*)"',
)


def prompts() -> dict[str, tuple[str, str]]:
    """Prologue and epilogue by representation."""
    return {ir: (prologue, EPILOGUE) for ir, prologue in PROLOGUES.items()}


def prompt_table(spark) -> DataFrame:  # noqa: ANN001
    """_ir, prologue, epilogue: four rows."""
    return spark.createDataFrame([(k, a, b) for k, (a, b) in prompts().items()], "_ir string, prologue string, epilogue string")


def build_prompts(files: DataFrame) -> DataFrame:
    """Adds prompt = prologue + content + epilogue to rows (ir, content); rows of other representations are dropped."""
    table = prompt_table(files.sparkSession)  # four rows: always broadcast
    return files.join(F.broadcast(table), F.lower("ir") == F.col("_ir")).drop("_ir").withColumn("prompt", F.concat("prologue", F.coalesce("content", F.lit("")), "epilogue")).drop("prologue", "epilogue")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def clean_response(c: Column) -> Column:
    """A model's answer without its code fences; null and empty stay."""
    body = strip(c)
    body = F.when(F.startswith(body, F.lit("```")) & F.contains(body, F.lit("\n")), F.regexp_replace(body, "^[^\n]*\n", "")).otherwise(body)
    body = F.when(F.endswith(body, F.lit("```")), F.left(body, F.length(body) - 3)).otherwise(body)
    return F.when(c.isNull() | (c == ""), c).otherwise(strip(body))


def custom_id(model: Column, index: Column) -> Column:
    return F.format_string("%s_file_%04d", model, index)


def provider(model: Column) -> Column:
    """Which client serves a model; unknown models go to the first."""
    low = F.lower(model)
    first = F.contains(model, F.lit("gpt")) | F.contains(low, F.lit("openai")) | F.contains(model, F.lit("o4"))
    second = F.contains(model, F.lit("claude")) | F.contains(low, F.lit("anthropic"))
    return F.when(first, "openai").when(second, "anthropic").otherwise("openai")


def is_reasoning(model: Column) -> Column:
    """Reasoning models get no temperature."""
    return model.rlike("(?i)o1|o3")


def safe_name(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def address(c: Column) -> Column:
    """Lower case, stripped, without a leading 0x."""
    return F.regexp_replace(F.lower(strip(c)), "^0x", "")


def file_address(path: Column) -> Column:
    """The address that a source file is named after: its stem without a leading 0x, lower case. 0x goes before the case does, so
    0X1 keeps its 0x."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.lower(F.regexp_replace(stem, "^0x", ""))


def result_path(root: Column, model: Column, extension: Column, relative: Column) -> Column:
    """root / model / extension without dot / directories / stem.c"""
    ext = F.regexp_replace(extension, r"^\.", "")
    folder = F.regexp_extract(relative, "^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(relative, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("/", root, F.translate(model, "/:", "__"), ext, F.nullif(folder, F.lit("")), F.concat(stem, F.lit(".c")))


def legacy_path(path: Column, model: Column) -> Column:
    """<base>_<model>_response<ext>"""
    ext = F.regexp_extract(path, r"(?<=[^/])(\.[^./]*)$", 1)
    base = F.left(path, F.length(path) - F.length(ext))
    return F.concat(base, F.lit("_"), model, F.lit("_response"), ext)


def with_extension(path: Column, extension: str) -> Column:
    """The path with its last extension replaced."""
    return F.regexp_replace(path, r"\.[^./]*$", extension)


def strip_source_includes(c: Column) -> Column:
    """A harness without the includes of generated sources."""
    for pattern in SOURCE_INCLUDES:
        c = F.regexp_replace(c, pattern, "")
    return c


def assemble_source(deps: Column, body: Column) -> Column:
    return F.concat(F.coalesce(deps, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in per cent as text, 0 of 0 as 0."""
    share = F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    return F.format_string(f"%.{digits}f%%", share)


def history(user: Column, assistant: Column) -> Column:
    """A conversation of a user's message and the answer to it."""
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("user", user), ("assistant", assistant))))


def append_message(messages: Column, content: Column, role: str = "user") -> Column:
    """The conversation with one message more; a null one starts."""
    own = F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    return F.when(messages.isNull(), own).otherwise(F.concat(messages, own))

"""Which functions are leaves: no call, and no jump out of the function's own blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import strip

# Register names.
REGISTERS = [
    "rax", "rbx", "rcx", "rdx", "rsi", "rdi", "rbp", "rsp", "r8", "r9", "r10", "r11", "r12", "r13", "r14", "r15",
    "eax", "ebx", "ecx", "edx", "esi", "edi", "ebp", "esp", "ax", "bx", "cx", "dx", "si", "di", "bp", "sp",
    "al", "bl", "cl", "dl", "ah", "bh", "ch", "dh",
]
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLOCK = "^block_(0x[0-9a-fA-F]+):"
JUMP = r"(?i)^j[a-z]{1,3}[ \t]+(.+)$"
CALL = r"(?i)^call[ \t]+"
HEX = "(0x[0-9a-fA-F]+)"


def _code(line: Column) -> Column:
    """A line without its comment."""
    return strip(F.split(line, ";", 2)[0])


def is_register_jump(operand: Column) -> Column:
    low = F.lower(strip(operand))
    indirect = F.contains(low, F.lit("[")) | F.contains(low, F.lit("ptr"))
    # a name inside an indirect operand is looked for as text; names that contain another are not needed
    return low.isin(REGISTERS) | (indirect & low.rlike("|".join(REGISTERS)))


def with_verdict(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds blocks (labels of the file), reason ("call", "external_jump" or null) and kept. A null content, as of a file that
    can't be read, is not kept."""
    out = files.withColumn("_lines", F.split(F.col(content), LINE_ENDS))
    labels = F.transform("_lines", lambda x: F.lower(F.regexp_extract(strip(x), BLOCK, 1)))
    out = out.withColumn("blocks", F.array_distinct(F.filter(labels, lambda x: x != "")))
    out = out.withColumn("_code", F.transform("_lines", _code))
    out = out.withColumn("_operands", F.filter(F.transform("_code", lambda x: F.regexp_extract(x, JUMP, 1)), lambda x: x != ""))

    def leaves(operand: Column) -> Column:
        target = F.lower(F.regexp_extract(operand, HEX, 1))
        return is_register_jump(operand) | ((target != "") & ~F.array_contains("blocks", target))

    call = F.col("_code").isNull() | F.exists("_code", lambda x: x.rlike(CALL))
    reason = F.when(call, "call").when(F.exists("_operands", leaves), "external_jump")
    return out.withColumn("reason", reason).withColumn("kept", reason.isNull()).drop("_lines", "_code", "_operands")


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: n_files, n_kept, n_call, n_external_jump."""
    return verdicts.agg(
        F.count("*").alias("n_files"), F.count_if("kept").alias("n_kept"),
        F.count_if(F.col("reason") == "call").alias("n_call"), F.count_if(F.col("reason") == "external_jump").alias("n_external_jump"),
    )


def passing_functions(functions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of the address map whose name is the stem of a file that is kept; sanitised names never match."""
    return functions.join(verdicts.where("kept").select("name").distinct(), "name", "left_semi")

"""Disassembly and intermediate-representation text: headers, code lines, blocks in the order of their addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(content: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(content, f"(?m)^{name}: ?(.*)$", 1), F.lit(""))


def parse_representation(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds function_name, architecture, entry_point (null where the header lacks them) and code, the text after "code:"."""
    c = F.col(content)
    out = files.withColumn("function_name", _field(c, "Function Name")).withColumn("architecture", _field(c, "Architecture")).withColumn("entry_point", _field(c, "Entry Point"))
    return out.withColumn("code", F.regexp_extract(c, r"(?s)(?:^|\n)code:\n(.*)$", 1))


def code_lines(files: DataFrame, code: str = "code") -> DataFrame:
    """A row per line "0xaddr: text": line (0-based), address and instruction; other lines have no address."""
    rows = files.select("*", F.posexplode(F.split(F.col(code), "\n")).alias("line", "_text")).where("_text <> ''")
    address = F.regexp_extract("_text", r"^\s*(0x[0-9a-fA-F]+): ?", 1)
    out = rows.withColumn("address", F.nullif(address, F.lit("")))
    return out.withColumn("instruction", F.regexp_replace("_text", r"^\s*0x[0-9a-fA-F]+: ?", "")).drop("_text")


def listing(blocks: DataFrame) -> DataFrame:
    """One text per function from its basic blocks (name, start, text), by start address. A function's blocks meet in one row."""
    own = F.array_sort(F.collect_list(F.struct(F.conv(F.regexp_replace("start", "^0x", ""), 16, 10).cast("decimal(20,0)").alias("at"), "text")))
    return blocks.groupBy("name").agg(own.alias("b")).select("name", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("content"))


def own_functions(functions: DataFrame) -> DataFrame:
    """Functions (is_plt, is_simprocedure) that are neither linkage stubs nor stand-ins of library procedures."""
    return functions.where(~F.coalesce("is_plt", F.lit(False)) & ~F.coalesce("is_simprocedure", F.lit(False)))


def split_empty(files: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Files with content, and those without (logged and left out)."""
    empty = F.length(F.coalesce(F.col(content), F.lit(""))) == 0
    return files.where(~empty), files.where(empty)


def split_undefined(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions with a definition, and those without, which make one error row each."""
    lacking = F.nullif(F.col("func_def"), F.lit("")).isNull()
    return functions.where(~lacking), functions.where(lacking).withColumn("error", F.lit("empty func_def"))

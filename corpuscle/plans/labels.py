"""Labels of compile errors, as rows and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import taxonomy
from corpuscle.operators import rollup
from corpuscle.plans import views as v


def compile_labels(spark: SparkSession, sf: str, version: str = "detailed", *, keep: bool = False) -> DataFrame:
    """A row for each file and label; keep: with the file's content."""
    files = taxonomy.with_labels(v.compile_errors(spark, sf), "content", taxonomy.COMPILE[version])
    return rollup.explode_labels(files if keep else files.drop("content"), F.col("found")).drop("found")


def sql_compile(version: str = "detailed") -> str:
    return f"(SELECT * EXCLUDE (content, l), l.category AS category, l.subcategory AS subcategory FROM (SELECT *, unnest({taxonomy.sql_labels('content', taxonomy.COMPILE[version])}) AS l FROM v_compile_errors))"


CONFIG_STATS = """SELECT *, sum(n_labels) OVER (PARTITION BY {keys})::BIGINT AS total_labels, sum(n_labels) OVER (PARTITION BY {keys}, category)::BIGINT AS n_category,
sum(n_labels) OVER (PARTITION BY {keys}, category) / sum(n_labels) OVER (PARTITION BY {keys}) AS category_share, n_labels / sum(n_labels) OVER (PARTITION BY {keys}, category) AS share_of_category
FROM (SELECT {keys}, category, subcategory, count(*) AS n_labels FROM {rows} GROUP BY ALL)"""

"""Counts and proportions of labels by configuration, iteration and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIG = ["model", "ir", "opt"]
LABEL = ["category", "subcategory"]


def explode_labels(files: DataFrame, found: Column) -> DataFrame:
    """A row per label of a file; files without labels go. The outer form keeps the optimiser from inferring a filter on the
    labels, which would find them a second time below the generator."""
    rows = files.withColumn("_l", F.explode_outer(found)).where(F.col("_l").isNotNull())
    return rows.select("*", "_l.category", "_l.subcategory").drop("_l")


def label_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """n_labels by the keys and the label."""
    return labels.groupBy(*keys, *LABEL).agg(F.count("*").alias("n_labels"))


def config_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to counts: the configuration's total, the category's count and its share, and the subcategory's share of the category.
    The windows run over counts, whose number doesn't grow with the files."""
    whole, cat = Window.partitionBy(*keys), Window.partitionBy(*keys, "category")
    out = counts.withColumn("total_labels", F.sum("n_labels").over(whole)).withColumn("n_category", F.sum("n_labels").over(cat))
    return out.withColumn("category_share", F.col("n_category") / F.col("total_labels")).withColumn("share_of_category", F.col("n_labels") / F.col("n_category"))


def iteration_rollup(counts: DataFrame) -> DataFrame:
    """Counts per iteration and over all ("(all)"), with shares of the category and of the total, from one pass over counts."""
    sets = [["iteration", *LABEL], LABEL]
    own = counts.groupingSets([[F.col(c) for c in s] for s in sets], F.col("iteration"), *(F.col(c) for c in LABEL)).agg(F.sum("n_labels").alias("n_labels"))
    own = own.withColumn("iteration", F.coalesce("iteration", F.lit("(all)")))
    it, cat = Window.partitionBy("iteration"), Window.partitionBy("iteration", "category")
    out = own.withColumn("n_total", F.sum("n_labels").over(it)).withColumn("n_category", F.sum("n_labels").over(cat))
    return out.withColumn("proportion_of_category", F.try_divide("n_labels", "n_category")).withColumn("proportion_of_total", F.try_divide("n_labels", "n_total"))


def combinations(files: DataFrame, found: Column, keys: list[str]) -> DataFrame:
    """How many files have exactly a set of labels; combination is the sorted labels as cat:sub, comma-joined."""
    names = F.transform(found, lambda x: F.concat_ws(":", x["category"], x["subcategory"]))
    rows = files.withColumn("combination", F.array_join(F.array_sort(names), ","))
    return rows.where(found.isNotNull()).groupBy(*keys, "combination").agg(F.count("*").alias("n_files"))


def top_combinations(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most common of each key value; ties by text."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n_files"), "combination"))
    return counts.withColumn("place", rank).where(F.col("place") <= k)


def label_shares(counts: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The k most common combinations over all, with their files per label: label_share divides files by the labels of all files, as
    the printed summaries do. counts: combination, n_files; labels: counts of labels (n_labels)."""
    top = counts.orderBy(F.desc("n_files"), "combination").limit(k)
    return top.crossJoin(labels.agg(F.coalesce(F.sum("n_labels"), F.lit(0)).alias("total_labels"))).withColumn("label_share", F.col("n_files") / F.col("total_labels"))  # one row


def top_category(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The category with most labels of each configuration; ties by name."""
    cats = counts.groupBy(*keys, "category").agg(F.sum("n_labels").alias("n_category"))
    best = F.min(F.struct((-F.col("n_category")).alias("less"), F.col("category").alias("category"))).alias("b")
    return cats.groupBy(*keys).agg(best).select(*keys, F.col("b.category").alias("top_category"), (-F.col("b.less")).alias("n_category"))


def first_values(stats: DataFrame, keys: list[str], limits: dict[str, int]) -> DataFrame:
    """Rows within the first values of some columns, each within those before it in `keys`; for displays that show a few."""
    out = stats
    for i, key in enumerate(keys):
        if key in limits and not i:
            first = out.select(key).distinct().orderBy(key).limit(limits[key])
            out = out.join(F.broadcast(first), key, "left_semi")  # limits[key] rows
        elif key in limits:
            rank = F.dense_rank().over(Window.partitionBy(*keys[:i]).orderBy(key))
            out = out.withColumn("_rank", rank).where(F.col("_rank") <= limits[key]).drop("_rank")
    return out

"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share by weight of BUDGET times all words, at most CAP times its own words; the excess is reshared
by weight. Each document of a source is to be taken target / words of the source times: a whole part, and a probability that
dependent rounding makes 0 or 1. Two documents with fractional probabilities exchange expected words at random, so that one
of the probabilities becomes 0 or 1 and their expected words stay the same; each keeps its own probability in the mean.
Blocks of about BLOCK documents are worked off in this way, one residual document of each goes to the next level, and so on
up a reduction tree until each source has one residual. That one is taken in part, which makes the words of a source exact
to one, or with whole=True taken or left at random.

Only DataFrame functions run. Scale: one pass over the texts gives narrow rows; a level shuffles one row in BLOCK of the
level before, and blocks are dealt by a hash of the row (doc_id, text, and a number among rows that repeat both), so a source of any
size, and the rows of one that repeats, spread over many tasks. Sources are put in order by ranges, whose sums are added up,
so that any number of them spreads too. Draws are hashes of rows: reruns agree.

Defined results: a text without words (also null and empty) has size 0 and taken 0; a null source is a source of its own,
the last; rows that repeat are mixed one by one, and a null doc_id is one like any other; a text of any length is one document, taken
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm import _base

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
BLOCK = 64
SEED = 5
#: Rows of a stretch of a row that repeats.
REPEATS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, most: int = REPEATS) -> DataFrame:
    """doc_id, text_key (a hash of the text), nth (among rows that repeat all the rest), source and size, the number of words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    counted = every.groupBy("doc_id", "text_key", "source", "size").agg(F.count("*").alias("n"))
    return numbered(counted, most)


def numbered(counted: DataFrame, most: int = REPEATS) -> DataFrame:
    """A row for each of n, numbered by nth from 1. Rows that repeat more than `most` times are dealt out as stretches of `most` first."""
    key = [c for c in counted.columns if c != "n"]
    upto = lambda n: F.sequence(F.lit(1).cast("long"), n)
    few = counted.where(F.col("n") <= most).select(*key, F.explode(upto(F.col("n"))).alias("nth"))
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long"))).alias("start")
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, since a stretch is small before it is dealt out
    dealt = counted.where(F.col("n") > most).select(*key, "n", stretch).repartition(tasks, *key, "start")
    many = dealt.select(*key, "start", F.explode(upto(F.least(F.lit(most), F.col("n") - F.col("start")))).alias("own"))
    return few.unionByName(many.select(*key, (F.col("start") + F.col("own")).alias("nth")))


def _running(rows: DataFrame, order: list[str], sums: list[str], root: str) -> tuple[DataFrame, dict[str, float]]:
    """Adds before_<c>, the sum of c over all rows before in the order, without one task that sees all rows: rows are dealt by ranges,
    summed within them, and the sums of the ranges before are added. And the sums over all."""
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = _base.written(dealt, root)
    parts = {r["part"]: r for r in dealt.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).collect()}  # one row a range
    starts, total = [], dict.fromkeys(sums, 0.0)
    for part in sorted(parts) or [-1]:
        starts.append(F.struct(F.lit(part).alias("part"), *(F.lit(float(total[c])).alias(f"start_{c}") for c in sums)))
        total = {c: total[c] + parts[part][c] for c in sums} if parts else total
    begin = rows.sparkSession.range(1).select(F.inline(F.array(*starts)))  # literals: a table made from Python rows would need Python workers
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0.0)).alias(f"before_{c}") for c in sums))
    out = within.join(F.broadcast(begin), "part")  # one row a range
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"start_{c}"))
    return out.drop("part", *(f"start_{c}" for c in sums)), total


def targets(rows: DataFrame, root: str) -> DataFrame:
    """source, source_size, target and n of each source."""
    own = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    own = own.withColumn("none", F.col("source").isNull())
    placed, _ = _running(own.withColumn("one", F.lit(1.0)), ["none", "source"], ["one"], f"{root}/places")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("before_one").cast("long") % len(WEIGHTS) + 1).cast("int"))
    own = placed.withColumn("weight", weight).withColumn("most", F.col("source_size") * CAP).withColumn("reach", F.col("most") / F.col("weight"))
    # sources reach their caps in the order of reach; level: words a unit of weight if all before stand at their caps
    ranked, total = _running(own.drop("one", "before_one"), ["reach", "none", "source"], ["most", "weight"], f"{root}/reaches")
    level = (F.lit(BUDGET / CAP * total["most"]) - F.col("before_most")) / (F.lit(total["weight"]) - F.col("before_weight"))
    free = ranked.withColumn("level", level).where("level <= reach").agg(F.min(F.struct("reach", "none", "source", "level")).alias("f")).first()["f"]
    target = F.col("most") if free is None else F.least(F.col("most"), F.lit(free["level"]) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"), "n")


ROW = ("doc_id", "text_key", "nth")


def _draw(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _pair(state: Column, e: Column, level: int) -> Column:
    """One exchange: the settled document goes to `done`, the other becomes `cur`."""
    cur, done = state["cur"], state["done"]
    ratio = e["size"] / cur["size"]
    p, q = cur["p"], e["p"]
    up = F.least(1 - p, ratio * q)
    down = F.least(p, ratio * (1 - q))
    rise = _draw(*(x[c] for x in (cur, e) for c in ROW), F.lit(level), F.lit(SEED)) * (up + down) < down

    def item(x: Column, prob: Column) -> Column:
        return F.struct(x["size"].alias("size"), *(x[c].alias(c) for c in ROW), prob.alias("p"))

    def to(settled: Column, rest: Column) -> Column:
        return F.struct(rest.alias("cur"), F.concat(done, F.array(settled)).alias("done"))

    one, zero = F.lit(1.0), F.lit(0.0)
    clip = lambda x: F.least(one, F.greatest(zero, x))
    return (
        F.when((p <= 0) | (p >= 1), to(item(cur, p), item(e, q)))
        .when(rise & (1 - p <= ratio * q), to(item(cur, one), item(e, clip(q - (1 - p) / ratio))))
        .when(rise, to(item(e, zero), item(cur, clip(p + ratio * q))))
        .when(p <= ratio * (1 - q), to(item(cur, zero), item(e, clip(q + p / ratio))))
        .otherwise(to(item(e, one), item(cur, clip(p - ratio * (1 - q)))))
    )


def _round(rows: DataFrame, level: int) -> DataFrame:
    """source, the row, size and p after the exchanges of each block."""
    item = F.struct("size", *ROW, "p")
    blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(item)).alias("items"))
    none = F.slice(F.col("items"), 1, 0)
    start = F.struct(F.element_at("items", 1).alias("cur"), none.alias("done"))
    ended = F.aggregate(F.expr("slice(items, 2, size(items))"), start, lambda s, e: _pair(s, e, level))
    out = blocks.select("source", ended.alias("s")).select("source", F.explode(F.concat(F.col("s.done"), F.array("s.cur"))).alias("i"))
    return out.select("source", *(f"i.{c}" for c in ROW), "i.size", "i.p")


def mix(docs: DataFrame, *, whole: bool = False) -> DataFrame:
    """doc_id, text_key, nth, size, source, source_size, target, copies (double: times the document is taken) of every row."""
    spark = docs.sparkSession
    root = _base.scratch(spark)
    rows = _base.written(sizes(docs), f"{root}/sizes")
    own = _base.written(targets(rows, root), f"{root}/sources")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # a null-safe join on source; the table of sources is broadcast only below Spark's own size threshold
    base = rows.join(own.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("mean", mean)
    part = F.when(F.col("size") > 0, F.col("mean") - F.floor("mean")).otherwise(F.lit(0.0))
    first = base.select("source", *ROW, "size", part.alias("p"))

    most = own.agg(F.max("n")).first()[0] or 0
    fraction, level, settled = (F.col("p") > 0) & (F.col("p") < 1), 0, [first.where("p <= 0 or p >= 1")]
    left = first.where(fraction)
    while most > 1:
        n = left.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("source", "of")
        dealt = left.join(n, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(*ROW, F.lit(level), F.lit(SEED)), F.col("blocks")))
        done = _base.written(_round(dealt, level), f"{root}/level{level}")
        settled.append(done.where("p <= 0 or p >= 1"))
        left, level = done.where(fraction), level + 1
        most = 1 if most <= BLOCK else -(-most // BLOCK)
    if whole:
        left = left.withColumn("p", (_draw(*map(F.col, ROW), F.lit(SEED + 1)) < F.col("p")).cast("double"))
    for more in settled:
        left = left.unionByName(more)
    given = own.withColumnRenamed("source", "of").withColumn("mean", mean)
    out = left.join(given, F.col("source").eqNullSafe(F.col("of")))
    copies = F.when(F.col("size") > 0, F.floor("mean") + F.col("p")).otherwise(F.lit(0.0))
    return out.select(*ROW, "size", "source", "source_size", "target", copies.alias("copies"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_base.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", F.round(F.col("copies") * F.col("size")).cast("long").alias("taken"))

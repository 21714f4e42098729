"""Deep comparison of JSON outputs without Python workers, level by level.

Both texts become VARIANT values. A pair of values holds if their kinds are the same and, by kind, the scalars are equal (floats within
1e-9 of their size), the arrays are as long, or the observed object's keys are in the expected one; an array or object then gives the
pairs of its items, which are the next level. All of this is within a row, so levels shuffle nothing; what is written of a level are its
verdicts and the items of the next one, and there are as many levels as the deepest value has. A row is the same if none of its pairs
failed.

Texts that VARIANT does not hold as json.loads() does (NaN and infinities, keys that come twice, integers beyond 64 bits, escapes of
lone surrogates, what is no JSON at all) go to `verify.same_json` in Arrow batches; the others never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators import verify
from corpuscle.sources.shared import scratch, written

#: Numbers that may be integers beyond 64 bits, and escapes of surrogates.
HARD = r"[0-9]{18}|\\u[dD][89a-fA-F]"


def kind(value: Column) -> Column:
    """object, array, float, int, string, bool or null, as json.loads() tells them apart; SQL null of a value that is not there."""
    told = F.schema_of_variant(value)
    known = F.when(F.startswith(told, F.lit("OBJECT")), "object").when(F.startswith(told, F.lit("ARRAY")), "array")
    known = known.when(F.startswith(told, F.lit("DECIMAL")) | told.isin("DOUBLE", "FLOAT"), "float").when(told == "STRING", "string").when(told == "BOOLEAN", "bool")
    return known.when(told == "VOID", "null").when(told.isNotNull(), "int")


def _as(value: str, to: str) -> Column:
    return F.try_variant_get(value, "$", to)


def _judged(pairs: DataFrame) -> DataFrame:
    """_row, ok, and the pairs of items (o, e) of a pair (_row, o, e) that holds so far; none for scalars."""
    both = pairs.select("_row", "o", "e", kind(F.col("o")).alias("ko"), kind(F.col("e")).alias("ke"))
    is_a = lambda *kinds: F.col("ko").isin(*kinds)
    of = lambda k, to: [F.when(F.col("ko") == k, _as(c, to)) for c in ("o", "e")]
    close = lambda a, b: (a == b) | (F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    scalar = F.when(is_a("float"), close(_as("o", "double"), _as("e", "double"))).when(is_a("int"), _as("o", "long") == _as("e", "long"))
    scalar = scalar.when(is_a("string", "bool"), _as("o", "string") == _as("e", "string")).when(is_a("null"), True)
    (oa, ea), (om, em) = of("array", "array<variant>"), of("object", "map<string, variant>")
    wide = both.select("_row", (F.col("ko") == F.col("ke")).alias("same_kind"), "ko", scalar.alias("scalar"), oa.alias("oa"), ea.alias("ea"), om.alias("om"), em.alias("em"))
    ok = F.when(is_a("array"), F.size("oa") == F.size("ea")).when(is_a("object"), True).otherwise(F.col("scalar"))
    ok = F.coalesce(F.col("same_kind") & ok, F.lit(False))
    listed = F.zip_with("oa", "ea", lambda a, b: F.struct(a.alias("o"), b.alias("e")))
    keyed = F.transform(F.map_keys("om"), lambda k: F.struct(F.try_element_at("om", k).alias("o"), F.try_element_at("em", k).alias("e")))
    return wide.select("_row", ok.alias("ok"), F.when(ok & is_a("array"), listed).when(ok & is_a("object"), keyed).alias("items"))


def with_same(rows: DataFrame, observed: str, expected: str, name: str = "same") -> DataFrame:
    """Adds whether two JSON texts hold the same value by the rules of verify.same_value(); null if either is none."""
    root = scratch(rows.sparkSession)
    o, e = F.try_parse_json(observed), F.try_parse_json(expected)
    easy = o.isNotNull() & e.isNotNull() & ~F.col(observed).rlike(HARD) & ~F.col(expected).rlike(HARD)
    base = written(rows.select("*", F.monotonically_increasing_id().alias("_row"), F.coalesce(easy, F.lit(False)).alias("_easy")), f"{root}/rows")
    pairs, level, failed = base.where("_easy").select("_row", o.alias("o"), e.alias("e")), 0, None
    while level == 0 or not pairs.isEmpty():
        judged = written(_judged(pairs), f"{root}/level{level}")
        bad = judged.where("not ok").select("_row")
        failed = bad if failed is None else failed.unionByName(bad)
        pairs = judged.where("size(items) > 0").select("_row", F.explode("items").alias("i")).select("_row", "i.o", "i.e")
        level += 1
    easy_rows = base.where("_easy").join(failed.distinct().withColumn("_bad", F.lit(True)), "_row", "left").withColumn(name, F.col("_bad").isNull()).drop("_bad")
    hard = base.where("not _easy")
    columns = [*rows.columns, name]
    if hard.isEmpty():
        return easy_rows.select(*columns)
    return easy_rows.select(*columns).unionByName(hard.withColumn(name, verify.same_json(observed, expected)).select(*columns))

"""Level-by-level comparison against the recursion."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.operators import deep_compare, verify

KIND = "i int, o string, x string"
scalars = st.none() | st.booleans() | st.integers(-3, 3) | st.integers(-(2**40), 2**40) | st.floats(allow_nan=False, allow_infinity=False) | st.sampled_from([0.0, -0.0, 1.0, 1e300, 1e-12, 0.5]) | st.text(max_size=3)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "a.b", "", "$[0]", "é"]), x, max_size=3), max_leaves=12)


def near(value, dice):
    """A value like the given one, changed in few places."""
    if isinstance(value, list):
        out = [near(v, dice) for v in value]
        return out[:-1] if out and dice.random() < 0.1 else out
    if isinstance(value, dict):
        out = {k: near(v, dice) for k, v in value.items()}
        if dice.random() < 0.2:
            out["more"] = 1
        if out and dice.random() < 0.1:
            out.pop(next(iter(out)))
        return dict(reversed(out.items())) if dice.random() < 0.3 else out
    if dice.random() < 0.1:
        return dice.choice([None, True, 1, 1.0, "1", [], {}])
    if isinstance(value, float) and dice.random() < 0.5:
        return value * (1 + dice.choice([1e-11, 1e-7]))
    return float(value) if type(value) is int and dice.random() < 0.1 else value


@settings(max_examples=12, deadline=None)
@given(st.lists(values, min_size=1, max_size=60), st.integers(0, 10**6))
def test_equals_the_recursion(spark, given_values, seed):
    dice = random.Random(seed)
    pairs = [(v, near(v, dice)) for v in given_values] + [(a, b) for a, b in zip(given_values, given_values[1:], strict=False)]
    rows = [(i, json.dumps(a, ensure_ascii=dice.random() < 0.5), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    got = {r["i"]: r["same"] for r in deep_compare.with_same(spark.createDataFrame(rows, KIND), "o", "x").collect()}
    assert got == {i: verify.same_value(a, b) for i, (a, b) in enumerate(pairs)}


HARD = [
    ("NaN", "NaN"), ("[Infinity]", "[Infinity]"), ('{"a": 1, "a": 2}', '{"a": 2}'), ("123456789012345678901", "123456789012345678901"), ("123456789012345678901", "123456789012345678901.0"), ('"\\ud800"', '"\\ud800"'),
    ("1", None), ("{", "{"), ("", ""), ("9223372036854775807", "9223372036854775807"), ("1.0", "1"), ("1e3", "1000.0"), ("[]", "{}"), ("{}", "[1]"), ('{"a": null}', "{}"), ("{}", '{"a": null}'), ("null", "null"), ('{"a": null}', '{"a": null}'),
    ("0.1", "0.10000000000000000000000000000000000000001"), ("true", '"true"'), ("[[[[[[[[1]]]]]]]]", "[[[[[[[[1]]]]]]]]"), ("[[[[[[[[1]]]]]]]]", "[[[[[[[[2]]]]]]]]"),
]


def test_what_variants_do_not_hold(spark):
    def want(a, b):
        (ok, x), (also, y) = verify._parsed(a), verify._parsed(b)
        return verify.same_value(x, y) if ok and also else None

    rows = [(i, a, b) for i, (a, b) in enumerate(HARD)]
    got = {r["i"]: r["same"] for r in deep_compare.with_same(spark.createDataFrame(rows, KIND), "o", "x").collect()}
    assert got == {i: want(a, b) for i, a, b in rows}


def test_plain_values_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, 2.5, "x"]}', '{"a": [1, 2.5, "x"], "b": 1}'), (2, "1", "2")], KIND)
    out = deep_compare.with_same(rows.coalesce(1), "o", "x")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["i"], r["same"]) for r in out.collect()} == {(1, True), (2, False)}
    assert deep_compare.with_same(rows.where("i > 5"), "o", "x").count() == 0

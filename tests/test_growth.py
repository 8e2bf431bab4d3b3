"""What makes work grow: words that are shuffled, rows that are computed again, copies of rows."""

import pytest
from pyspark.sql import functions as F

from quern.functions import display
from quern.operators import census, dictionary, nested, resolve
from quern.plans import catalogue

KEYS = ["k", "part", "sub"]


@pytest.fixture
def no_guess(spark):
    """Sizes that Spark doesn't know, as of derived tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def segments(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition("k")
    return dictionary.segments(rows, "k", "name")


def test_rungs_read_what_the_earlier_ones_left(spark):
    """F16: no rung computes the rows again."""
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, name string")
    read = []

    def rung(name):
        def find(left):
            read.append(len(left.inputFiles()))
            return left.where(F.col("name") == name).select("k", F.lit(name).alias("target"))

        return name, find

    found = resolve.cascade(spark, rows, "k", [rung("a"), rung("b")])
    assert all(read) and {(r.k, r.rung, r.target) for r in found.collect()} == {(1, "a", "a"), (2, "b", "b"), (3, "none", None)}


def test_codes_meet_once_and_are_never_cut(spark, tmp_path):
    """a code of 14 digits isn't the one of its first 13."""
    spark.createDataFrame([(7,), (70,), (1234567890123,), (123456789012,), (1234567890120,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    met = catalogue.q_multiform_join(spark, str(tmp_path))
    assert "Generate" not in plan_of(met)
    assert sorted(map(tuple, met.collect())) == [(7, 70), (123456789012, 1234567890120)]


def test_scalars_of_a_walk_are_kept_as_values(spark):
    """only objects and arrays are written as VARIANT, and a census reads none."""
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}], "c": null}'), (2, "{"), (3, None)], "k long, text string")
    walked = census.walk(spark, rows, "k", "text")
    assert "variant" not in plan_of(walked).lower()
    found = {(r.path, r.type, r.records, r.n, tuple(r.words or ())) for r in census.census(walked, "k").collect()}
    assert found == {("$", "OBJECT", 1, 1, ()), ("$", "malformed", 1, 1, ()), ("$.a", "ARRAY", 1, 1, ()), ("$.a[*]", "BIGINT", 1, 1, ("1",)), ("$.a[*]", "OBJECT", 1, 1, ()), ("$.a[*].b", "STRING", 1, 1, ("x",)), ("$.c", "VOID", 1, 1, ())}


def test_words_of_rules_are_not_shuffled(spark, no_guess):
    """F10."""
    rules = spark.createDataFrame([(1, "red bolt", ["old bolt"], None), (2, "bolt", [], "B"), (3, "ring", ["bolt"], "R")], "rule long, term string, excludes array<string>, result string")
    found = dictionary.first_rules(segments(spark, ["red bolts", "red bolt old bolt", "ring", "bolt ring", "rods"]), KEYS, rules)
    plan = plan_of(found)
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(k#") == 1
    assert {(r.k, r.rule, r.result) for r in found.collect()} == {(0, 1, None), (1, 2, "B"), (2, 3, "R"), (3, 2, "B")}


def test_uncovered_words_need_no_join_with_their_names(spark, no_guess):
    """F13."""
    terms = spark.createDataFrame([("red bolt",), ("bolt ring",), ("rod",)], "term string")
    found = segments(spark, ["a red bolts ring, rod", "red ring red", "rod rod"])
    rest = dictionary.uncovered(found, KEYS, terms)
    plan = plan_of(rest)
    assert "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(k#") == 1
    old = dictionary.residual(found, KEYS, dictionary.longest_only(dictionary.hits(found, KEYS, terms), KEYS))
    rows = lambda df: sorted((r.k, r.part, tuple(r.words), tuple(r.rest)) for r in df.collect())
    assert rows(rest) == rows(old)
    assert rows(rest) == [(0, 0, ("a", "red", "bolt", "ring"), ("a",)), (0, 1, ("rod",), ()), (1, 0, ("red", "ring", "red"), ("red", "ring", "red")), (2, 0, ("rod", "rod"), ())]


def test_forms_of_an_item_are_computed_once(spark):
    """F14."""
    rows = spark.createDataFrame([(" 2% or less of salt; ",), ("_milk_",), ("and",), ("12 %",), ("Lot Code 5",), ("--",), ("sugar",), ("5 percent",), (None,)], "raw string")
    found = rows.select("raw", display.cleaned_item(F.col("raw")).alias("c"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("or\\s+less") == 1
    assert [tuple(r.c) for r in found.collect()] == [
        ("rename", "salt", "a quantity before it"), ("rename", "milk", "marked up"), ("drop", None, "a torn piece of a list"), ("drop", None, "digits"), ("drop", None, "words of a package"),
        ("drop", None, "nothing left"), ("keep", "sugar", None), ("keep", "5 percent", None), ("rename", None, "signs around it"),
    ]


def test_tokens_are_tried_by_the_rules_they_can_meet(spark):
    """rules are tried only on tokens that have their signs, in either case."""
    said = ["LESS THAN 2% Salt", "Contains 1 PERCENT OR LESS OF: Sugar. Cocoa", "TRACES OF Nut", "plain", "Ingredients: Oats", "St. Ives", "**Rye*", "3% Malt CONTAINS Barley"]
    rows = spark.createDataFrame([(0, ", ".join(said))], "k long, t string")
    plan = nested.scan(rows, "k", "t")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(lower(token#" in plan
    found = {(r.name, r.note) for r in nested.items(rows, "k", "t").collect()}
    assert found == {("salt", "less than 2%"), ("sugar", "trace"), ("cocoa", "trace"), ("nut", "trace"), ("plain", "trace"), ("oats", "trace"), ("st. ives", "trace"), ("rye", "trace"), ("malt", "trace")}


def test_rules_stay_small_enough_to_be_compiled(spark):
    """the JVM interprets methods of more than 8,000 bytes for ever; and no row holds the set of all items beside it."""
    rows = spark.createDataFrame([(0, "a, b (c, d)")], "k long, t string")
    conf = {"spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = nested.items(rows, "k", "t")._jdf.queryExecution().executedPlan()
        assert "collect_set" not in plan.toString()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) <= 8000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

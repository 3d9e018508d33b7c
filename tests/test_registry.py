import pytest
from pyspark.sql import functions as F

from sonorant.operators import registry
from sonorant.operators.registry import Metric, entry, guarded

KEYS = ["id"]


def inverse(x):
    return 1 / x, None, None


REGISTRY = (
    Metric("size", lambda: entry(F.length("text")), needs=("text",)),
    Metric("llm_wer", lambda: guarded(inverse, F.col("x")), needs=("x",), judged=True),
    Metric("llm_cer", lambda: entry(F.lit(0.5)), judged=True, follows="llm_wer"),
    Metric("lost", lambda: entry(F.col("absent")), needs=("absent",), judged=True),
)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, x double")


def test_a_failing_metric_leaves_the_others(spark):
    df = registry.evaluated(pairs(spark, [(1, "ab", 2.0), (2, "abc", 0.0), (3, None, None)]), ["llm_wer", "llm_cer", "lost"], REGISTRY)
    got = {r.id: r.metrics for r in df.collect()}
    assert got[1]["size"].value == 2 and got[1]["llm_wer"].value == 0.5 and got[1]["llm_cer"].value == 0.5
    assert got[2]["size"].value == 3 and got[2]["llm_wer"].error == got[2]["llm_cer"].error and got[2]["llm_wer"].error.startswith("ZeroDivisionError")
    assert got[3]["size"].value is None and got[3]["size"].error is None and got[3]["llm_wer"].error.startswith("TypeError")
    assert all(m["lost"].error == "columns are missing: absent" for m in got.values())


def test_choice_of_metrics(spark):
    keys = lambda asked: [m.key for m in registry.chosen(asked, REGISTRY)]
    assert keys([]) == ["size"] and keys(["llm_cer"]) == ["size"] and keys(["llm_cer", "llm_wer"]) == ["size", "llm_wer", "llm_cer"]
    with pytest.raises(ValueError):
        keys(["other"])


def test_without_a_judge(spark):
    got = registry.evaluated(pairs(spark, [(1, "ab", 2.0)]), ["llm_wer", "llm_cer"], REGISTRY, judge=False).first().metrics
    assert got["size"].value == 2 and got["llm_wer"].error == got["llm_cer"].error == "No judge configured."


def test_a_later_run_tries_only_what_failed(spark):
    asked = ["llm_wer", "llm_cer"]
    past = registry.outcomes(registry.evaluated(pairs(spark, [(1, "ab", 2.0), (2, "abc", 0.0)]), asked, REGISTRY), KEYS)
    rows = pairs(spark, [(1, "zzzz", 8.0), (2, "abc", 4.0), (3, "a", 0.0)])
    owed = {r.id: r.due for r in registry.due(rows, KEYS, asked, REGISTRY, past, 3).collect()}
    assert owed == {2: ["llm_cer", "llm_wer"], 3: ["llm_cer", "llm_wer", "size"]}
    after = registry.again(rows, KEYS, asked, REGISTRY, past)
    got = {(r.id, r.metric): (r.value, r.error is None, r.attempts) for r in after.collect()}
    assert got[1, "size"] == (2, True, 1) and got[1, "llm_wer"] == (0.5, True, 1), "settled outcomes stay though the row has changed"
    assert got[2, "llm_wer"] == (0.25, True, 2) and got[2, "size"] == (3, True, 1)
    assert got[3, "llm_wer"] == (None, False, 1) and got[3, "size"] == (1, True, 1)
    assert {r.id for r in registry.due(rows, KEYS, asked, REGISTRY, after, 1).collect()} == set(), "attempts are used up"
    assert {(r.metric, r.rows) for r in registry.failures(after).collect()} == {("llm_wer", 1), ("llm_cer", 1)}
    maps = {r.id: r.metrics for r in registry.as_metrics(after, KEYS).collect()}
    assert maps[2]["llm_wer"].value == 0.25 and set(maps[3]) == {"size", "llm_wer", "llm_cer"}


def test_empty_tables(spark):
    none = pairs(spark, [])
    past = registry.outcomes(registry.evaluated(none, ["llm_wer"], REGISTRY), KEYS)
    assert past.count() == 0 and registry.again(none, KEYS, ["llm_wer"], REGISTRY, past).count() == 0


def test_metrics_are_computed_once(spark, tmp_path):
    from sonorant.queries import QUERIES

    spark.createDataFrame([(1, 1, "user", "a b c")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = QUERIES["metric_outcomes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_distances") == 1 and plan.count("ArrowEvalPython") == 2

"""Stages of judging, doubts and objects in loose text on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from sonorant.functions import acoustic, verdicts
from sonorant.operators import plans, staging, tasks

METRICS = "run_id string, clip_id string, provider string, status string, sampled boolean, metrics map<string, struct<value: double, error: string, errors: double, length: double>>"


def test_judge_stage_empties_what_is_not_sampled(spark):
    entry = lambda v: (v, None, None, None)
    rows = [("r", f"c{k:02}", "p", "failed" if k == 0 else "ok", True, {"wer": entry(0.5), "a": entry(1.0)} | ({"b": entry(1.0)} if k == 1 else {})) for k in range(22)]
    out = staging.judge_stage(spark.createDataFrame(rows, METRICS), ("a", "b"), 0.1, 3, 1).collect()
    assert {r.clip_id for r in out} == {f"c{k:02}" for k in range(2, 22)}
    assert sum(r.selected for r in out) == 3
    for r in out:
        assert r.sampled == r.selected
        assert r.metrics["a"].value == (1.0 if r.selected else None)
        assert ("b" in r.metrics) == (not r.selected)
        assert r.metrics["wer"].value == 0.5
    assert staging.judge_stage(spark.createDataFrame(rows, METRICS), (), 0.1, 3, 1).count() == 0


def test_a_failed_judge_fails_both_of_its_rates(spark):
    entry = lambda v, e: (v, e, None, None)
    rows = [("r", "a", "p", "ok", True, {"llm_wer": entry(None, "down"), "llm_cer": entry(0.1, None), "wer": entry(0.2, None)}), ("r", "b", "p", "ok", True, {"llm_wer": entry(0.1, None), "llm_cer": entry(0.1, None)}), ("r", "c", "p", "ok", True, {"llm_cer": entry(0.3, None)})]
    got = {r.clip_id: r.metrics for r in staging.isolated(spark.createDataFrame(rows, METRICS)).collect()}
    assert (got["a"]["llm_cer"].value, got["a"]["llm_cer"].error, got["a"]["wer"].value) == (None, "down", 0.2)
    assert (got["b"]["llm_cer"].value, got["c"]["llm_cer"].value) == (0.1, 0.3)


def test_progress_without_work_is_done(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0), (2, 1, 1, 4, 4), (9, 9, 9, 4, 4)], "transcribed long, skipped long, scored long, total long, to_score long")
    assert [r.fraction for r in staging.progress(rows).collect()] == [1.0, 0.5, 1.0]


@pytest.mark.parametrize(
    "text, held",
    [
        ("", None), (None, None), ("no object", None), ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('so {"a": "}"} then {"b": 2}', {"a": "}"}), ('x {"a": "\\"}{"} y', {"a": '"}{'}), ('{"a": {"b": {}}} tail', {"a": {"b": {}}}),
        ('{"a": 1', None), ("} {", None), ('x {"a": "' + "\\\\" * 50_000 + '"} y', {"a": "\\" * 50_000}),
    ],
)
def test_object_in_loose_text(spark, text, held):
    got = spark.createDataFrame([(text,)], "t string").select(verdicts.json_object(F.col("t")).alias("o")).first().o
    assert (got and json.loads(got)) == held


def test_letter_texts(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["ab"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(verdicts.letter_text(F.col("t"))).collect()] == [True, False, False]


def test_windows_meet_between_letters(spark):
    rows = spark.createDataFrame([([(2, 4), (7, 9), (20, 21)], 30), ([(3, 4)], 8), ([], 8)], "s array<struct<start: int, end: int>>, n int")
    got = [[tuple(w) for w in r[0]] for r in rows.select(acoustic.windows(F.col("s"), F.col("n"))).collect()]
    assert got == [[(0, 5), (5, 14), (14, 30)], [(0, 8)], []]


def test_doubts_are_counted_only_if_asked(spark):
    ops = [(0, "a", False, False), (1, "b", False, False), (2, "c", True, False), (3, "d", False, True), (9, "e", False, False), (None, "f", False, False)]
    rows = spark.createDataFrame([(ops, [-1.0, 1.0, -1.0, -1.0])], "ops array<struct<ref_index: int, ref: string, mistake: boolean, heard: boolean>>, llr array<double>")
    for count in (False, True):
        r = tasks.audio_doubts(rows, 0.0, count).first()
        assert r.doubts == ["a"]
        assert [o.mistake for o in r.ops] == [count, False, True, False, False, False]
        assert [o.category for o in r.ops] == ["acoustic" if count else None, *[None] * 5]


def test_weights_of_nothing_stay(spark):
    plan = spark.createDataFrame([("x", "wer", 0.5), ("x", "cer", 0.5), ("y", "wer", 1.0)], "agent string, metric string, weight double")
    got = {(r.agent, r.metric): r.weight for r in plans.set_weights(plan, {"wer": -3.0}, "agent").collect()}
    assert got == {("x", "wer"): 0.0, ("x", "cer"): 1.0, ("y", "wer"): 0.0}


def test_tasks_of_plans_and_scores_follow_the_rows(spark, monkeypatch):
    from sonorant import session
    from sonorant.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    want = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    for name in ("plan_changed_weights", "plan_runnable", "usecase_score"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == want, name


def test_objects_by_one_expression_are_those_of_the_fold(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    texts = ["".join(rng.choice('{}{}"\\a:1 \n') for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ['{"a":' * n + "1" + "}" * m for n in (6, 7, 40) for m in (n - 1, n)] + ["x" * 50_000 + '{"a": "' + "{y\\\"" * 50_000 + '"} z', "{" + "[1] " * 50_000 + "}"]
    tail = F.regexp_extract("t", r"(?s)\{.*", 0)
    end = verdicts.balanced_end(tail)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", verdicts.balanced(F.col("t")).alias("got"), F.when(end > 0, F.substring(tail, F.lit(1), end)).alias("want"))
    assert rows.where("NOT got <=> want").limit(3).collect() == []
    assert rows.where("got IS NOT NULL").count() > 300


def test_an_answer_is_searched_once(spark):
    from pyspark.sql import functions as F

    from sonorant.functions import payloads

    plan = spark.range(1).select(payloads.requirements(F.col("id").cast("string")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("parse_json") <= 2


def test_white_space_of_any_kind_is_cut(spark):
    from pyspark.sql import functions as F

    from sonorant.functions import payloads

    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
    rows = spark.createDataFrame([(f"{c} a{c}b {c}",) for c in [*spaces, "\u200b", "\x1c", "é"]], "t string")
    assert rows.select(payloads.cut(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).where("a <> b").collect() == []

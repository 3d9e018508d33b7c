import json

from pyspark.sql import functions as F

from sonorant.functions import payloads


def run(spark, f, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.r for r in df.select("k", f(F.col("t")).alias("r")).orderBy("k").collect()]


def test_requirements(spark):
    full = {"use_case": " Bank ", "user_actions": ["pay", " ", None, 3], "semantic_matters": "", "exact_transcription_matters": 1, "objective": None, "fields": [{"name": " a ", "type": "AMOUNT", "why": 5}, {"name": ""}, {"type": "date"}, "x", None, {"name": "b", "type": ["q"]}]}
    good, empty, cut, array, none, wrong = run(spark, payloads.requirements, ["so: " + json.dumps(full) + " end", "{}", '{"use_case": "', "[1]", None, '{"fields": {"name": "a"}}'])
    assert good.error is None and good.use_case == "Bank" and good.user_actions == ["pay", "3"] and good.objective == ""
    assert good.semantic_matters is False and good.exact_matters is True
    assert [tuple(f) for f in good.fields] == [("a", "amount", "5"), ("b", "other", "")]
    assert empty.error is None and empty.use_case == "Unclassified" and empty.semantic_matters is True and empty.exact_matters is False and empty.fields == []
    assert cut.error == array.error == none.error == "no object" and cut.use_case is None
    assert wrong.error == "fields are no list"


def test_scenarios_keep_the_last_value_of_a_name(spark):
    values = [{"field": "a", "value": 1}, {"field": " ", "value": "x"}, {"field": "b", "value": " y "}, {"field": "a", "value": "2"}, {"field": "c"}]
    good, wrong = run(spark, payloads.scenario, [json.dumps({"sentence": " s ", "values": values}), '{"values": 3}'])
    assert good.sentence == "s" and [tuple(p) for p in good.expected] == [("a", "2"), ("b", "y"), ("c", "")] and good.notes == ""
    assert wrong.error == "values are no list"


def test_requests_and_replies(spark):
    a, b, c, d, e = run(spark, payloads.reading_request, ['{"level": "word", "text": " घर ", "gop_threshold": 0}', '{"level": "x"}', "[]", "{", '{"gop_threshold": "low"}'])
    assert (a.error, a.level, a.text, a.threshold, a.audio_decides) == (None, "word", " घर ", 0.0, True)
    assert (b.error, c.error, d.error, e.error) == ("unknown level: x", "no object", "no object", "threshold is no number")
    df = spark.createDataFrame([(1, '{"text": "घर"}'), (2, "no")], "id long, t string").withColumn("r", payloads.reading_request(F.col("t")))
    good, bad = payloads.divided(df, "r")
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
    assert json.loads(good.select(payloads.document(F.col("r")).alias("j")).first().j) == {"error": None, "level": "paragraph", "text": "घर", "typed": "", "engine": "", "threshold": -2.0, "audio_decides": True}

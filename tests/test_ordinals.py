import pytest
from pyspark.sql import functions as F

from sonorant.operators.ordinals import numbered
from sonorant.sources import truth


def test_numbers_are_gapless_and_in_order(spark):
    rows = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), (F.col("id") * 7919 % 5000).alias("v"))
    got = numbered(rows.repartition(11), ["k", "v"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(1, 5001))
    assert [(r.k, r.v) for r in got] == sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_equal_rows_empty_tables_and_names(spark):
    rows = spark.createDataFrame([("a", 1)] * 300 + [("b", None)] * 5, "`x.y` string, v int")
    got = numbered(rows, ["x.y"], "n", 0).collect()
    assert sorted(r.n for r in got) == list(range(305)) and {r["x.y"] for r in got if r.n >= 300} == {"b"}
    assert numbered(rows.limit(0), ["v"]).count() == 0
    with pytest.raises(ValueError):
        numbered(rows.withColumnRenamed("v", "ordinal"), ["x.y"])


def test_no_window_over_the_rows(spark):
    plan = numbered(spark.range(100), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate" in plan[plan.index("Window"):]


def test_a_folder_of_both_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,text\r\nx.wav,café\r\n\r\ny,\"two\r\nlines, \"\"so\"\"\"\r\n".encode())
    (tmp_path / "b.csv").write_bytes(" Transcript , ID,more\nnaïve,z,1\n,w\nlater,dir/x.mp3\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"\n\n")
    (tmp_path / "d.csv").write_bytes(b"name,text\nq,r\n")
    good, bad = truth.read_truth_files(spark, str(tmp_path))
    assert sorted(map(tuple, good.collect())) == [("x", "café"), ("y", 'two\r\nlines, "so"'), ("z", "naïve")]
    got = sorted((r.file[-5:], r.line or 0, r.reason, r.id) for r in bad.collect())
    assert got == [("b.csv", 0, "latin-1", None), ("b.csv", 3, "empty_text", "w"), ("b.csv", 4, "duplicate_id", "x"), ("c.csv", 0, "empty", None), ("d.csv", 0, "no_columns", None)]


def test_long_fields_need_no_recursion(spark, tmp_path):
    long = "word, " * 200_000
    (tmp_path / "a.csv").write_text(f'id,text\na,"{long}"\n')
    good, bad = truth.read_truth_files(spark, str(tmp_path))
    assert good.first().text == long.strip() and bad.count() == 0

import re

from sonorant.queries import QUERIES


def test_all_of_a_text_is_normalised(spark, tmp_path):
    texts = {1: "Long  TEXT, it's über—fine! " * 40, 2: "x" * 299 + " Y,z", 3: "", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = {k: re.sub(" +", " ", re.sub("[^a-z0-9_' ]", " ", re.sub("[^ -~]", "", t or "").lower())).strip() for k, t in texts.items()}
    assert {r.doc_id: r.normal for r in QUERIES["tokenize_normalize"](spark, str(tmp_path)).collect()} == plain

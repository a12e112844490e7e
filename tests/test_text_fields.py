import re

import __spark_entry__ as entry


def test_whole_texts_are_tokenised_and_marked(spark, tmp_path):
    texts = {1: "sand and " + "filler words " * 40 + "the End and last9", 2: "", 3: None, 4: "x" * 300 + " band"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["marked"], r["tokens"]) for r in entry.queries()["whole_text_fields"](spark, str(tmp_path)).collect()}
    want = {k: t if t is None else (t.replace("and", "[and]"), sorted(set(re.findall(r"[a-z0-9]+", t.lower())))) for k, t in texts.items()}
    assert got == want | {3: (None, None)}

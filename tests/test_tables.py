"""Stored tables: batches, replays and deletions against the operators over all rows."""

from pyspark.sql import functions as F

from quern.operators import lexicon as L
from quern.operators import tables as B
from tests.conftest import rows


def files(table):
    return {b: tuple(sorted(B._Files(table.spark, table.path).names(f"rows/bucket={b}/version={v}"))) for b, v in table.state.folders.items()}


def test_merges_equal_the_operator_over_all_rows(spark, tmp_path):
    key = ["headword_id", "lang", "source"]
    all_ = spark.range(600).select((F.col("id") % 70).alias("headword_id"), F.when(F.col("id") % 3 > 0, "en").alias("lang"), F.lit("s").alias("source"), F.concat(F.lit("d"), "id").alias("definition"), (F.col("id") % 2 == 0).alias("verified"), F.col("id").alias("arrival")).persist()
    parts = [all_.where("arrival < 200"), all_.where("arrival between 200 and 399"), all_.where("arrival >= 400")]
    for name, rule, whole in (("defs", B.definitions, L.upsert_definitions), ("last", B.keep_last(key), lambda r: L.last_wins(r, key, "arrival")), ("first", B.keep_first(key), lambda r: L.first_wins(r, key, "arrival"))):
        table = B.create(spark, str(tmp_path / name), all_.drop("arrival").schema, key, buckets=8)
        for n, part in enumerate(parts):
            table = table.merge(n, part, rule)
        assert table.merge(1, parts[0], rule) is table  # a batch that comes again
        want = whole(all_).select(*table.rows.columns)
        if name == "defs":  # null languages are keys here too, which a join of counts leaves out
            want = want.where("lang is not null")
            assert rows(table.rows.where("lang is not null")) == rows(want)
        else:
            assert rows(table.rows) == rows(want)
        assert B.open_table(spark, table.path).state == table.state


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rows_ = spark.range(500).select("id", F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("arrival"))
    table = B.create(spark, str(tmp_path / "t"), "id long, value string", ["id"], buckets=16).merge(0, rows_, B.keep_first(["id"]))
    before = files(table)
    one = table.merge(1, spark.createDataFrame([(7, "new", 0), (7, "newer", 1), (1000, None, 2)], "id long, value string, arrival long"), B.keep_last(["id"]))
    after = files(one)
    changed = {b for b in before if after[b] != before[b]}
    assert 1 <= len(changed) <= 2 and one.rows.count() == 501
    assert [tuple(r) for r in one.rows_of(spark.createDataFrame([(7,), (1000,), (5000,)], "id long")).orderBy("id").collect()] == [(7, "newer"), (1000, None)]
    gone = one.delete(2, F.col("value").isin("newer", "v9"))
    assert gone.rows.count() == 499 and gone.delete(2, F.col("id") > 0) is gone
    fewer = gone.delete_keys(3, spark.range(100, 150))
    assert fewer.rows.count() == 449 and rows(table.rows) == rows(rows_.drop("arrival"))  # earlier versions are still there
    fewer.vacuum()
    assert fewer.rows.count() == 449 and fewer.delete(4, F.lit(True)).rows.count() == 0


def test_headwords_take_the_first_part_of_speech(spark, tmp_path):
    schema = "traditional string, simplified string, pinyin string, pos string"
    data = [("銀", "银", "yin2", "", 0), ("銀", "银", "yin2", None, 1), ("行", "行", "xing2", "v", 2)]
    later = [("銀", "银", "yin2", "n", 0), ("行", "行", "xing2", "n", 1)]
    kind = schema + ", arrival long"
    table = B.create(spark, str(tmp_path / "w"), schema, ["traditional", "simplified", "pinyin"], 4)
    table = table.merge(0, spark.createDataFrame(data, kind), B.headwords).merge(1, spark.createDataFrame(later, kind), B.headwords)
    assert rows(table.rows.select("traditional", "pos")) == [("行", "v"), ("銀", "n")]
    assert table.merge(2, spark.createDataFrame([], kind), B.headwords).rows.count() == 2

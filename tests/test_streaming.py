import json

from pyspark.sql import functions as F

from quern.streaming import ingest as I
from tests.conftest import rows


def put(folder, name, *articles):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("source", "source_article_id", "title", "text"), a, strict=True))) for a in articles))


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    put(tmp_path / "in", "1.json", ("s", "1", "t", "第一句话。第二句话。"), ("s", "1", "t", "重复的文章。"), ("s", "2", "t", "  "))
    go = lambda: I.ingest(I.article_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert rows(read("chunks").select("source_article_id", "chunk_index", "text")) == [("1", 0, "第一句话。"), ("1", 1, "第二句话。")]
    go()
    assert read("chunks").count() == 2
    put(tmp_path / "in", "2.json", ("s", "1", "t", "晚到的同一篇。"), ("s", "3", "t", "新的文章来了。"))
    go()
    assert rows(read("chunks").select("source_article_id").distinct()) == [("1",), ("3",)]
    assert read("postings").where("token = '新'").count() == 1


def test_windows(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' ts, 1 k union all select timestamp '2024-01-01 00:20:00', 1 union all select timestamp '2024-01-01 02:00:00', 1").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k int").parquet(str(tmp_path / "e"))
    for name, df in (("w", I.windowed_counts(stream, "ts", ["k"], "1 hour")), ("s", I.session_counts(stream, "ts", ["k"], "30 minutes"))):
        df.writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.table(f"out_{name}").select("n")) == [(1,), (2,)]
    first = I.first_per_key(stream, ["k"], "ts", "1 day")
    first.writeStream.format("memory").queryName("out_f").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("out_f").count() == 1
    assert I.windowed_counts(stream, "ts", ["k"], "1 hour", "30 minutes").isStreaming
    assert F.lit(1) is not None


def test_progress_is_what_was_written(spark, tmp_path):
    put(tmp_path / "in", "1.json", ("s", "1", "t", "第一句话。第二句话。"), ("s", "1", "t", "重复的文章。"))
    put(tmp_path / "in", "2.json", ("s", "2", "t", "新的文章来了。"), ("s", "1", "t", "晚到的同一篇。"))
    told = []
    stream = I.article_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    I.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), report=lambda n, x: told.append((n, x))).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out" / "chunks"))
    assert [n for n, _ in told] == [0, 1] and sum(x["articles"] for _, x in told) == 2
    for number, x in told:
        own = written.where(F.col("batch") == number)
        assert (x["chunks"], x["characters"]) == tuple(own.agg(F.count(F.lit(1)), F.coalesce(F.sum("char_count"), F.lit(0))).first())

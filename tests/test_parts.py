import pytest
from pyspark.sql import functions as F

from quern.plans import parts as P
from tests.conftest import rows


class Broken(Exception):
    pass


def failing(after):
    calls = []

    def work(todo):
        calls.append(1)
        if len(calls) > after:
            raise Broken
        return todo.where("k is null or k % 5 <> 0").select("k", F.concat("v", F.lit("!")).alias("w"))

    return work, calls


def test_a_broken_run_goes_on_without_a_part_twice(spark, tmp_path):
    data = [(k, f"v{k}") for k in range(40)] + [(None, "none"), (7, "again")]
    df = spark.createDataFrame(data, "k long, v string")
    path, seen = str(tmp_path / "out"), []
    work, calls = failing(2)
    with pytest.raises(Broken):
        P.run_in_parts(df, ["k"], work, path, parts=6, progress=lambda n, made: seen.append((n, made)))
    assert [n for n, _ in seen] == [0, 1] and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("aside")]
    first = rows(P.published(spark, path, "k long, w string"))
    assert 0 < len(first) == sum(made for _, made in seen)
    (tmp_path / "out" / "aside-left" / "todo").mkdir(parents=True)  # what a lost driver leaves
    work, calls = failing(100)
    got = P.run_in_parts(df, ["k"], work, path, parts=9)
    assert rows(got) == rows(spark.createDataFrame([(k, v + "!") for k, v in data if k is None or k % 5], "k long, w string"))
    assert 1 <= len(calls) <= 9 and set(first) <= set(rows(got))
    work, calls = failing(100)
    more = P.run_in_parts(df.union(spark.createDataFrame([(41, "new")], "k long, v string")), ["k"], work, path)
    assert len(calls) == 1 and more.count() == got.count() + 1  # keys without a row, 0 and 5, aren't done again
    work, calls = failing(100)
    assert P.run_in_parts(df.limit(0), ["k"], work, path).count() == more.count()


def test_an_empty_table(spark, tmp_path):
    work, _ = failing(100)
    got = P.run_in_parts(spark.createDataFrame([], "k long, v string"), ["k"], work, str(tmp_path / "none"))
    assert got.columns == ["k", "w"] and got.count() == 0

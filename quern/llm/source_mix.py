"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies.

Everything is DataFrame operations. A source may hold any share of the rows, so documents are numbered per
block of a source (a size class and a hash of the id); block totals are summed in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, Stored

#: Weights that sources get in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and no document, is taken more than so many times its size.
MOST = 3
#: A size class of a source is dealt over enough blocks for each to hold about so many documents at most.
BLOCK_ROWS = 2_000
#: Copies are summed in fixed point, in units of 2**-30, so that sums are exact and don't depend on their order.
UNIT = 1 << 30


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, source_size, docs, target from (source, source_size, docs).

    Targets are min(most * size, level * weight) at the one level where they sum to share of all sizes, which is
    where capping sources and resharing the excess by weight ends. The level comes from a running sum over sources
    in order of the level at which each is capped. There is one row per source here, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(wheel, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        rows.withColumn("want", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
        .withColumn("level", (F.col("want") - F.col("capped")) / F.col("open_weight"))
    )
    # the first source, in order of full_at, that the level leaves below its cap fixes the level for all after it
    fixed = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)
    rows = rows.withColumn("level", fixed["level"])
    return rows.select("source", "source_size", "docs", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """How often the mix takes each document.

    Result: id_col, source, size long (words), source_size long, target double (its source's), copies long,
    taken long (size * copies), a row per input row. Within a source, documents stand in order of size class
    (binary digits of the size), hashed sub-block, size, and hashes of id and text. Each adds its expected copies,
    target / source_size, to a running sum that starts at one random offset of the source (from md5 of seed and
    source, so reruns agree), and is taken once per integer that its step crosses. As documents of like sizes
    stand together, taken words stay within a few documents of the target.

    Null texts have size 0 and cross integers like others, which takes 0 words. A null source is a source of its
    own, last in order. Null and repeated ids are rows of their own. A source of size 0 has target 0. Other columns
    are not read. An empty table gives no rows.
    """
    rows = _mixed(docs, id_col, text_col, source_col, seed, weights, most, share)
    return rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str = "mix", weights=WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """id, source, size, source_size, target, copies and a hash of the text, for each row."""
    store = Stored(docs.sparkSession, "mix")
    text = docs[text_col].cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    rows = store.keep(docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"), tie.alias("tie"), F.xxhash64(text).alias("tie2")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).cast("binary")), 1, 7), 16, 10).cast("long") * 4
    step = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double")) * float(UNIT) + 0.5), F.lit(0)).cast("long")
    targets = source_targets(sizes, weights, most, share)
    targets = targets.select(F.col("source").alias("of"), "source_size", "target", offset.alias("offset"), step.alias("step"), F.ceil(F.col("docs") / BLOCK_ROWS).cast("long").alias("blocks"))
    # a row per source: stored, so that Spark knows its size and broadcasts it only while it is small
    rows = rows.join(store.keep(targets, "targets"), F.col("source").eqNullSafe(F.col("of")))
    part = F.conv(F.substring("tie", 1, 8), 16, 10).cast("long") % F.col("blocks")
    rows = rows.withColumn("class", F.length(F.bin("size"))).withColumn("part", part)
    block = Window.partitionBy("source", "class", "part").orderBy("size", "tie", "tie2")
    rows = rows.withColumn("nth", F.row_number().over(block).cast("long"))
    before = Window.partitionBy("source").orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("source", "class", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = ahead.select(F.col("source").alias("of2"), F.col("class").alias("class2"), F.col("part").alias("part2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("of2")) & (F.col("class") == F.col("class2")) & (F.col("part") == F.col("part2")))
    start = (F.col("offset") + (F.col("ahead") % UNIT) * (F.col("step") % UNIT)) % UNIT
    crossed = lambda n: F.floor((start + n * F.col("step")) / F.lit(UNIT))
    return rows.withColumn("copies", (crossed(F.col("nth")) - crossed(F.col("nth") - 1)).cast("long"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs, all columns, each row as often as mix_sources takes it; rows that it takes 0 times go.

    Copies are joined to rows by id, source and text hash. Rows that agree in all three share what is taken of them.
    """
    key = lambda: (docs[id_col], docs[source_col].cast("string"), F.xxhash64(docs[text_col].cast("string")))
    found = _mixed(docs, id_col, text_col, source_col, **options).groupBy("id", "source", "tie2").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows"))
    found = found.where(F.col("all") > 0).select(F.col("id").alias("_a"), F.col("source").alias("_b"), F.col("tie2").alias("_c"), "all", "rows")
    a, b, c = key()
    rows = docs.select(F.struct(*docs.columns).alias("row"), a.alias("a"), b.alias("b"), c.alias("c"))
    rows = rows.join(found, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")) & (F.col("c") == F.col("_c")))
    alike = Window.partitionBy("a", "b", "c").orderBy(F.lit(0))
    single = rows.where("rows = 1").withColumn("times", F.col("all"))
    several = rows.where("rows > 1").withColumn("nth", F.row_number().over(alike))
    share = lambda n: F.floor(F.col("all") * n / F.col("rows"))
    several = several.withColumn("times", share(F.col("nth")) - share(F.col("nth") - 1))
    rows = single.select("row", "times").unionByName(several.select("row", "times"))
    rows = rows.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return rows.select(*(F.col("row").getField(x).alias(x) for x in docs.columns))

"""A stored inverted index that takes batches of changes, and searches that read a part of it.

Below its path are tables in folders by bucket and by segment, the number of the batch that wrote them:

- postings: token, slice, level, source, chunk_id, size, tf, positions, by bucket of the token's hash, in runs of many chunks
  that are sorted by token and slice. A slice is a share of the chunks, the same for all tokens, so counts can grow slice by slice. A level is a class
  of a token's weight in a chunk, so ranked search can leave low ones out.
- levels: for each token and level the number of postings, the largest count of the token and the least size of a chunk.
- totals: for each token and source by how many chunks and occurrences a batch changed them; their sums are true counts.
- chunks: whole rows by bucket of chunk_id. places: chunk_id by bucket of (source, source_article_id).
- dead: ids whose rows in earlier segments are no longer valid. sources: a row per source, for each version.

A version is a small file that names the segments of each bucket. It appears last, so a batch that broke off has changed
nothing, and one that is run again overwrites its own folders or, if its version is there, does nothing.

A deferred index stores a batch's chunks, places and sources only. refresh() brings those of the other tables up to date that
a reader asks for: texts that were replaced or deleted before are never split, and those that come in are split once.
"""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.operators import search as S

#: Shares of the chunks that counts read one after another, and postings that their first step reads, about; each next one reads three times as many.
SLICES, STEP_ROWS = 64, 1_000_000
#: Classes of weight, and the size of a chunk that they take for usual.
LEVELS, USUAL_SIZE = 16, 32
#: Tokens whose postings are sorted at once, and characters of texts that are split for that, about.
BLOCK_TOKENS, BLOCK_CHARS = 2_000_000, 12_000_000
#: Buckets that a task writes side by side, without sorting its rows by bucket.
OPEN_FILES = 64
#: Ids that are sent to all tasks, where their number is known; more are joined.
MOST_SENT = 4_000_000
#: Postings per term that ranked search looks at first, for each of the rows asked for.
SEED_ROWS = 50
ARTICLE = ("source", "source_article_id")
TABLES = ("postings", "levels", "totals", "chunks", "places")
#: Tables that are made from texts, in the order in which they are made.
DERIVED = ("postings", "totals", "levels")
#: Bytes of chunks that a task counts at once, and of counts that it adds up.
COUNT_BYTES = 32 << 20
#: Texts in other than Latin letters (up to U+017F; a dotted capital I becomes two letters), and which of these code points are letters or digits, whose runs are the tokens.
OTHER, IN_WORD = "[^\\x{0}-\\x{12F}\\x{131}-\\x{17F}]", np.array([chr(c).isalnum() for c in range(0x180)])
#: Which bytes are letters or digits by themselves.
IN_WORD_ALONE = np.where(np.arange(256) < 128, IN_WORD[:256], False)


def _bucket(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _block(batch: pa.RecordBatch):
    """Postings of a batch of chunks (chunk_id, source, slice, tokens), sorted by token and slice."""
    lists, n = batch.column("tokens"), batch.num_rows
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = int(sizes.sum())
    if not total:
        return
    coded = lists.flatten().dictionary_encode()
    if n > 1 and (total > BLOCK_TOKENS or len(coded.dictionary).bit_length() + n.bit_length() + int(sizes.max()).bit_length() > 63):
        yield from _block(batch.slice(0, n // 2))
        yield from _block(batch.slice(n // 2))
        return
    yield _run(batch, sizes, coded.indices.to_numpy(), coded.dictionary)


def _ranked_words(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places of tokens among the words in order, and these."""
    by_word = pc.sort_indices(words)
    rank = np.empty(len(by_word), np.int64)
    rank[by_word.to_numpy()] = np.arange(len(by_word))
    return rank[codes], words.take(by_word)


def _placed(order: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token the place of its chunk in an order of chunks."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return np.repeat(place, sizes)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _run(batch: pa.RecordBatch, sizes: np.ndarray, codes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """Postings of chunks by their tokens' codes: one sort of numbers made of token, chunk and place."""
    n, total = batch.num_rows, len(codes)
    n_bits, at_bits = n.bit_length(), int(sizes.max()).bit_length()
    ranked, words = _ranked_words(codes, words)
    by_slice = np.argsort(batch.column("slice").to_numpy(), kind="stable")
    at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = np.sort((ranked << (n_bits + at_bits)) | (_placed(by_slice, sizes) << at_bits) | at)
    pair = key >> at_bits
    first = _starts(pair)
    tf, pair = np.diff(np.append(first, total)), pair[first]
    chunk = by_slice[pair & ((1 << n_bits) - 1)]
    size = sizes[chunk]
    level = np.floor(LEVELS * tf / (tf + 1.2 * (0.25 + 0.75 * size / USUAL_SIZE))).astype(np.int32)
    positions = pa.ListArray.from_arrays(np.append(first, total).astype(np.int32), (key & ((1 << at_bits) - 1)).astype(np.int32))
    own = lambda c: batch.column(c).take(pa.array(chunk))
    columns = {"token": words.take(pa.array(pair >> n_bits)), "slice": own("slice"), "level": pa.array(level), "source": own("source"), "chunk_id": own("chunk_id"), "size": pa.array(size.astype(np.int32)), "tf": pa.array(tf.astype(np.int32)), "positions": positions}
    return pa.RecordBatch.from_pydict(columns)


def _counted(batch: pa.RecordBatch, sizes: np.ndarray, codes: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """token, source, docs, uses of chunks by their tokens' codes."""
    n_bits, total = batch.num_rows.bit_length(), len(codes)
    ranked, words = _ranked_words(codes, words)
    named = batch.column("source").dictionary_encode()
    source = pc.fill_null(named.indices, len(named.dictionary)).to_numpy()
    order = np.argsort(source, kind="stable")
    key = np.sort((ranked << n_bits) | _placed(order, sizes))
    first = _starts(key)
    tf, pair = np.diff(np.append(first, total)), key[first]
    token, source = pair >> n_bits, source[order[pair & ((1 << n_bits) - 1)]].astype(np.int64)
    first = _starts(token * (len(named.dictionary) + 1) + source)
    token, source = token[first], source[first]
    columns = {"token": words.take(pa.array(token)), "source": named.dictionary.take(pa.array(source, mask=source == len(named.dictionary))), "docs": pa.array(np.diff(np.append(first, len(pair)))), "uses": pa.array(np.add.reduceat(tf, first))}
    return pa.RecordBatch.from_pydict(columns)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of tokens of texts in Latin letters, and their tokens, told from the texts' bytes all at once."""
    texts = pc.utf8_lower(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return np.zeros(len(texts), np.int64), pa.array([], pa.string())
    data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    inside = IN_WORD_ALONE[data]
    lead = np.flatnonzero(data >= 0xC0)  # of characters of two bytes
    inside[lead] = inside[lead + 1] = IN_WORD[((data[lead] & 0x1F).astype(np.int32) << 6) | (data[lead + 1] & 0x3F)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    own = ends[:-1][ends[:-1] < len(data)]
    begins[own] = inside[own]  # no token goes on into the next text
    at, held = np.flatnonzero(begins), np.cumsum(inside, dtype=np.int32)
    offsets = np.append(held[at] - 1, held[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.diff(np.searchsorted(at, ends)), words


def _split(chunks: DataFrame, make, schema: str) -> DataFrame:
    """What make gives of blocks of chunks. Texts in Latin letters are split by the tasks that take their tokens, others by Spark's expression."""
    latin = ~F.rlike("text", F.lit(OTHER))
    rows = chunks.select("chunk_id", "source", _bucket(SLICES, "chunk_id").alias("slice"), F.when(latin, F.col("text")).alias("text"), F.when(~latin, X.tokens(F.col("text"))).alias("tokens"))

    def blocks(batches):
        for batch in batches:
            texts, tokens = batch.column("text"), batch.column("tokens")
            chars = np.cumsum(pc.add(pc.fill_null(pc.utf8_length(texts), 0), pc.multiply(pc.fill_null(pc.list_value_length(tokens), 0), 6)).to_numpy(zero_copy_only=False))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(chars, (chars[low - 1] if low else 0) + BLOCK_CHARS)))
                own = batch.slice(low, high - low)
                for column in ("text", "tokens"):
                    part = own.filter(own.column(column).is_valid())
                    if column == "text":
                        sizes, words = _words(part.column(column))
                    else:
                        sizes, words = pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False).astype(np.int64), part.column(column).flatten()
                    if len(words):
                        coded = words.dictionary_encode()
                        yield make(part, sizes, coded.indices.to_numpy(), coded.dictionary)
                low = high

    return rows.mapInArrow(blocks, schema)


def _kind(chunks: DataFrame, column: str) -> str:
    return chunks.schema[column].dataType.simpleString()


def _postings(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, token, slice, level, source, chunk_id, size, tf, positions, in runs that are sorted by token and slice. No shuffle."""
    rows = _split(chunks, _run, f"token string, slice int, level int, source {_kind(chunks, 'source')}, chunk_id {_kind(chunks, 'chunk_id')}, size int, tf int, positions array<int>")
    return rows.select(_bucket(buckets, "token").alias("bucket"), "*")


def _counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, token, source, docs, uses: counts of each block, to be added up."""
    rows = _split(chunks, _counted, f"token string, source {_kind(chunks, 'source')}, docs long, uses long")
    return rows.select(_bucket(buckets, "token").alias("bucket"), "*")


@dataclass(frozen=True)
class State:
    """A version: of each table, the segments of each bucket, and which of these hold dead rows; counts over all live chunks."""

    version: int = 0
    last_batch: int = -1
    buckets: int = 1024
    schema: str = ""
    segments: dict = field(default_factory=lambda: {t: {} for t in TABLES})
    dirty: dict = field(default_factory=lambda: {t: [] for t in TABLES})
    dead: list = field(default_factory=list)
    n_dead: int = 0
    n: int = 0
    size: int = 0
    n_sources: int = 0
    deferred: bool = False
    covered: dict = field(default_factory=dict)


class _Files:
    """The small files of versions, and folders that go."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def names(self, folder: str) -> list[str]:
        system, path = self.at(folder)
        return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []

    def read(self, name: str) -> str:
        system, path = self.at(name)
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write beside, then rename, which fails if another writer's file is there."""
        system, path = self.at(name)
        aside = self.at(f"{name}.new")[1]
        out = system.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if system.exists(path) or not system.rename(aside, path):
            raise RuntimeError(f"{name} was written by another job")

    def delete(self, name: str) -> None:
        system, path = self.at(name)
        system.delete(path, True)


def build(chunks: DataFrame, path: str, buckets: int = 1024, deferred: bool = False) -> Index:
    """Write the index of chunks (chunk_id, source, source_article_id, chunk_index, text and more) at a path, in place of what was there. buckets should grow with the vocabulary.

    Ids are expected once; of rows that share one the greatest by its columns is taken. Null texts have no tokens. A deferred
    index takes batches without splitting their texts, and is to be brought up to date by refresh() before it is searched.
    """
    spark = chunks.sparkSession
    _Files(spark, path).delete("")
    state = State(buckets=buckets, schema=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema), deferred=deferred)
    return Index(spark, path, state).apply(0, chunks)


def open_index(spark: SparkSession, path: str) -> Index:
    """The latest version of the index at a path."""
    files = _Files(spark, path)
    versions = [int(n.split(".")[0]) for n in files.names("versions") if n.endswith(".json")]
    if not versions:
        raise FileNotFoundError(f"no index at {path}")
    return Index(spark, path, State(**json.loads(files.read(f"versions/{max(versions)}.json"))))


@dataclass(frozen=True)
class Index:
    """One version; later ones don't change what it reads until vacuum()."""

    spark: SparkSession
    path: str
    state: State

    # -- tables

    def _schema(self, table: str) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in self._chunk_schema()}
        of = {
            "postings": f"token string, slice int, level int, source {kinds['source']}, chunk_id {kinds['chunk_id']}, size int, tf int, positions array<int>",
            "levels": "token string, level int, n long, most int, least int",
            "totals": f"token string, source {kinds['source']}, docs long, uses long",
            "chunks": self.state.schema,
            "places": f"source {kinds['source']}, source_article_id {kinds['source_article_id']}, chunk_index {kinds['chunk_index']}, chunk_id {kinds['chunk_id']}",
        }[table]
        return f"{of}, bucket int, segment int"

    def _chunk_schema(self):
        return T.StructType.fromDDL(self.state.schema)

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets' segments, dead ones too: only their folders are listed and read."""
        known = self.state.segments[table]
        picked = [b for b in known if buckets is None or int(b) in buckets]
        paths = [f"{self.path}/{table}/bucket={b}/segment={s}" for b in picked for s in known[b]]
        if not paths:
            return self.spark.createDataFrame([], self._schema(table))
        rows = self.spark.read.schema(self._schema(table)).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return rows if buckets is None else rows.where(F.col("bucket").isin(*sorted(map(int, picked))))

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.state.dead:
            return rows
        parts = [self.spark.read.parquet(f"{self.path}/dead/segment={s}").select("chunk_id", F.lit(s).alias("upto")) for s in self.state.dead]
        dead = parts[0]
        for more in parts[1:]:
            dead = dead.unionByName(more)
        dead = dead.groupBy("chunk_id").agg(F.max("upto").alias("upto"))
        dead = F.broadcast(dead) if self.state.n_dead <= MOST_SENT else dead
        return rows.join(dead, "chunk_id", "left").where(F.col("upto").isNull() | (F.col("segment") >= F.col("upto"))).drop("upto")

    @property
    def chunks(self) -> DataFrame:
        return self._live(self._read("chunks")).select(*(f.name for f in self._chunk_schema()))

    @property
    def sources(self) -> DataFrame:
        """source, chunk_count, article_count, min_chunk_id, max_chunk_id, as the last batch left them."""
        return self.spark.read.parquet(f"{self.path}/sources/{self.state.version}")

    def _buckets_of(self, rows: DataFrame, *columns: str) -> list[int]:
        """Buckets of rows' keys: as many as there are buckets at most."""
        return [r["b"] for r in rows.select(_bucket(self.state.buckets, *columns).alias("b")).distinct().collect()]

    def _buckets_of_keys(self, keys: list[tuple], schema: str) -> list[int]:
        """Buckets of a bounded list of keys, without a job."""
        kinds = [f.dataType for f in T.StructType.fromDDL(schema)]
        hashed = [F.xxhash64(*(F.lit(v).cast(t) for v, t in zip(key, kinds, strict=True))) for key in keys]
        found = self.spark.range(1).select(F.array(*(F.pmod(h, F.lit(self.state.buckets)).cast("int") for h in hashed))).first()[0]
        return sorted(set(found))

    def rows_of(self, ids: list) -> DataFrame:
        """Chunks of some ids, a bounded list: their buckets' folders, and ids as literals for the scan."""
        kind = self._chunk_schema()["chunk_id"].dataType.simpleString()
        if not ids:
            return self.chunks.limit(0)
        found = self._buckets_of_keys([(i,) for i in ids], f"chunk_id {kind}")
        rows = self._read("chunks", found).where(F.col("chunk_id").isin(*ids))
        return self._live(rows).select(*(f.name for f in self._chunk_schema()))

    # -- changes

    def _put(self, rows: DataFrame, table: str, segment: int) -> dict[str, list[int]]:
        """Write rows (bucket and more) as a segment's folders; the table's segments by bucket then. Tasks that meet few buckets write them side by side, in the order of their rows."""
        own = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
        if table in ("totals", "levels"):  # many counts for few bytes: less of them to a task, so that they stay in memory
            own |= {"spark.sql.files.maxPartitionBytes": str(COUNT_BYTES), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(COUNT_BYTES)}
        before = {name: self.spark.conf.get(name) for name in own}
        for name, value in own.items():
            self.spark.conf.set(name, value)
        write = rows.withColumn("segment", F.lit(segment)).write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("bucket", "segment")
        if table == "postings":  # of these few repeat in a file; tokens and sources do
            for column in ("chunk_id", "positions.list.element"):
                write = write.option(f"parquet.enable.dictionary#{column}", "false")
        try:
            write.parquet(f"{self.path}/{table}")
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)
        out = dict(self.state.segments[table])
        system, path = _Files(self.spark, self.path).at(table)
        for folder in system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/bucket=*/segment={segment}")) or []:
            b = folder.getPath().getParent().getName().split("=")[1]
            out[b] = [*out.get(b, []), segment]
        return out

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows by bucket and deal, a share of its keys: a bucket is dealt over tasks where there are more of these than buckets, and each of its files has a few tasks' rows."""
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return rows.withColumn("deal", F.pmod(F.hash(key), F.lit(-(-2 * tasks // self.state.buckets)))).repartition(tasks, "bucket", "deal")

    def _greatest(self, fresh: DataFrame) -> DataFrame:
        """Of rows that share an id the greatest, with its bucket: whole rows are shuffled."""
        names = [f.name for f in self._chunk_schema()]
        rows = self._dealt(fresh.withColumn("bucket", _bucket(self.state.buckets, "chunk_id")), "chunk_id").groupBy("bucket", "deal", "chunk_id")
        return rows.agg(F.max(F.struct(*(c for c in names if c != "chunk_id"))).alias("x")).select("bucket", "chunk_id", "x.*").select(*names, "bucket")

    def _one_an_id(self, fresh: DataFrame, segment: int) -> DataFrame:
        """A row of each id, with its bucket. A deferred index of few buckets looks for ids that come again first and shuffles their rows only; others are written where they are read."""
        if not self.state.deferred or self.state.buckets > OPEN_FILES:
            return self._greatest(fresh)
        path = f"{self.path}/again/{segment}"
        fresh.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id").write.mode("overwrite").parquet(path)
        again = self.spark.read.parquet(path)
        n = again.count()
        rows = fresh.withColumn("bucket", _bucket(self.state.buckets, "chunk_id"))
        if not n:
            return rows
        again = (F.broadcast(again) if n <= MOST_SENT else again).alias("a")
        shared = F.col("f.chunk_id").eqNullSafe(F.col("a.chunk_id"))
        return rows.alias("f").join(again, shared, "left_anti").unionByName(self._greatest(fresh.alias("f").join(again, shared, "left_semi")))

    def _only(self, table: str, segments: dict, segment: int) -> DataFrame:
        """What one segment has of a table."""
        state = dataclasses.replace(self.state, dead=[], segments={table: {k: [segment] for k, v in segments[table].items() if segment in v}})
        return Index(self.spark, self.path, state)._read(table)

    def _replaced(self, ids: DataFrame, segment: int) -> tuple[dict[int, int], list[DataFrame]]:
        """Rows of some ids that are there, by bucket, and the rows themselves, a few buckets' at a time. Ids are looked up first, so texts are read where they are and not shuffled."""
        gone, path = None, f"{self.path}/dead/segment={segment}"
        if self.state.n_sources:
            found = self._live(self._read("chunks", self._buckets_of(ids, "chunk_id")).select("chunk_id", "bucket", "segment"))
            found.join(ids, "chunk_id", "left_semi").select("chunk_id", "bucket").write.mode("overwrite").parquet(path)
            gone = self.spark.read.parquet(path)
        counts = {} if gone is None else {r["bucket"]: r["n"] for r in gone.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per bucket
        rounds, size = [], 0
        for b, n in sorted(counts.items()):
            if not rounds or size + n > MOST_SENT // 4:
                rounds.append([])
                size = 0
            rounds[-1].append(b)
            size += n
        names = [f.name for f in self._chunk_schema()]
        out = []
        for own in rounds:
            sent = gone.where(F.col("bucket").isin(*own)).select("chunk_id")
            sent = F.broadcast(sent) if sum(counts[b] for b in own) <= MOST_SENT else sent
            out.append(self._live(self._read("chunks", own)).join(sent, "chunk_id", "left_semi").select(*names))
        return counts, out

    def apply(self, number: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Index:
        """The index after a batch: rows of upserts in place of those of their ids, then without the ids (chunk_id) of deletes.

        number tells batches apart and grows; a batch whose number has been applied changes nothing. Only buckets of the
        batch's tokens, ids and articles, and of those that it replaces, are read or written. Texts are shuffled once, to
        bring the rows of an id together (if deferred, only those whose id comes again; upserts are then read twice and must
        be the same both times), and split into tokens once (if deferred, by refresh); postings are written by the tasks that
        make them.
        """
        if number <= self.state.last_batch:
            return self
        segment, b = self.state.version + 1, self.state.buckets
        names = [f.name for f in self._chunk_schema()]
        fresh = self.spark.createDataFrame([], self.state.schema) if upserts is None else upserts.select(*names)
        if deletes is not None:
            fresh = fresh.join(deletes.select("chunk_id").distinct(), "chunk_id", "left_anti")
        segments, dirty = dict(self.state.segments), {t: set(x) for t, x in self.state.dirty.items()}
        segments["chunks"] = self._put(self._one_an_id(fresh, segment), "chunks", segment)
        fresh = self._only("chunks", segments, segment).select(*names)
        # rows that the batch replaces or deletes, in the buckets of its ids
        ids = fresh.select("chunk_id")
        ids = ids if deletes is None else ids.unionByName(deletes.select("chunk_id"))
        gone, rounds = self._replaced(ids.distinct(), segment)
        removed = sum(gone.values())
        old = self.spark.createDataFrame([], self.state.schema).select("chunk_id", *ARTICLE)
        for i, rows in enumerate(rounds):
            mode = "append" if i else "overwrite"
            rows.select("chunk_id", *ARTICLE).write.mode(mode).parquet(f"{self.path}/replaced/{segment}")
            if self.state.deferred:
                continue
            first = (F.get("positions", F.lit(0)) == 0).cast("long")  # each chunk with tokens has one
            lost = _postings(rows, b).groupBy("bucket", "token", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"), F.sum(first).alias("chunks"))
            lost.write.mode(mode).parquet(f"{self.path}/lost/{segment}")
        old = self.spark.read.parquet(f"{self.path}/replaced/{segment}") if removed else old
        n = size = 0
        if not self.state.deferred:
            lost = self.spark.read.parquet(f"{self.path}/lost/{segment}") if removed else None
            out = lost.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.sum("uses"), F.lit(0))).first() if removed else (0, 0)
            n, size = self._derive(DERIVED, fresh, lost, segment, segments, dirty)
            n, size = n - out[0], size - out[1]
        segments["places"] = self._put(fresh.select(_bucket(b, *ARTICLE).alias("bucket"), *ARTICLE, "chunk_index", "chunk_id").repartition("bucket").sortWithinPartitions("bucket", *ARTICLE, "chunk_index"), "places", segment)
        if removed:
            dirty["chunks"] |= set(gone)
            dirty["places"] |= set(self._buckets_of(old, *ARTICLE))
        n_sources = self._count_sources(fresh, old, removed, segment)
        state = dataclasses.replace(
            self.state, version=segment, last_batch=number, segments=segments, dirty={t: sorted(x) for t, x in dirty.items()}, dead=[*self.state.dead, segment] if removed else self.state.dead,
            n_dead=self.state.n_dead + removed, n=self.state.n + n, size=self.state.size + size, n_sources=n_sources,
        )
        return self._publish(state)

    def _derive(self, tables, fresh: DataFrame, lost: DataFrame | None, segment: int, segments: dict, dirty: dict) -> tuple[int, int]:
        """Write a segment of derived tables for rows that came, and take counts of lost ones off. Chunks that have tokens, and these, if levels are among the tables."""
        b, posted = self.state.buckets, None
        if "postings" in tables:
            segments["postings"] = self._put(_postings(fresh, b), "postings", segment)
            posted = self._only("postings", segments, segment)
        elif "levels" in tables:  # the first ones, of postings that are there
            posted = self._live(self._read("postings"))
        if "totals" in tables:
            changed = _counts(fresh, b) if posted is None else posted.groupBy("bucket", "token", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))
            if lost is not None:
                changed = changed.unionByName(lost.select("bucket", "token", "source", (-F.col("docs")).alias("docs"), (-F.col("uses")).alias("uses")))
            if posted is None or lost is not None:
                changed = changed.groupBy("bucket", "token", "source").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))
            segments["totals"] = self._put(changed.sortWithinPartitions("bucket", "token"), "totals", segment)
        if "levels" in tables:
            levels = posted.groupBy("bucket", "token", "level").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("size").alias("least"))
            segments["levels"] = self._put(levels.sortWithinPartitions("bucket", "token"), "levels", segment)
        if lost is not None:
            touched = {r["bucket"] for r in lost.select("bucket").distinct().collect()}  # buckets at most
            for table in {"postings", "levels"} & set(tables):
                dirty[table] |= touched
        return (fresh.where(X.has_token(F.col("text"))).count(), posted.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]) if "levels" in tables else (0, 0)

    def behind(self, table: str) -> bool:
        """Whether a table waits for refresh()."""
        return self.state.deferred and table in DERIVED and self.state.covered.get(table, -1) < self.state.version

    def refresh(self, *tables: str) -> Index:
        """The index with postings, totals and levels (which need postings), or those that are named, up to date with its chunks. Of a deferred index only; others are."""
        wanted = [t for t in DERIVED if t in (tables or DERIVED)]
        wanted = [t for t in DERIVED if self.behind(t) and (t in wanted or (t == "postings" and "levels" in wanted))]
        if not wanted:
            return self
        if "levels" not in wanted and self.state.covered.get("levels", -1) >= 0 and "postings" in wanted:
            wanted.append("levels")  # levels are told from the postings of one segment, so they go on together
        now = {self.state.covered.get(t, -1) for t in wanted}
        if len(now) > 1:  # tables of different states: each is brought up by itself, postings and levels anew
            again = self._forget("postings", "levels") if "levels" in wanted else self
            return again.refresh(*(t for t in wanted if t != "totals")).refresh(*tables)
        since, segment = now.pop(), self.state.version + 1
        state, names = self.state, [f.name for f in self._chunk_schema()]
        chosen = lambda test: {"chunks": {k: own for k, v in state.segments["chunks"].items() if (own := [s for s in v if test(s)])}}
        at = lambda dead, test: Index(self.spark, self.path, dataclasses.replace(state, dead=dead, segments=chosen(test)))
        fresh = at([d for d in state.dead if d > since + 1], lambda s: s > since).chunks
        lost, later = None, [d for d in state.dead if d > since]
        if since >= 0 and later:
            dead = self.spark.read.parquet(*(f"{self.path}/dead/segment={d}" for d in later)).select("chunk_id").distinct()
            dead = F.broadcast(dead) if state.n_dead <= MOST_SENT else dead
            was = at([d for d in state.dead if d <= since], lambda s: s <= since)
            gone = was._live(was._read("chunks")).join(dead, "chunk_id", "left_semi").select(*names)
            _counts(gone, state.buckets).write.mode("overwrite").parquet(f"{self.path}/lost/{segment}")
            lost = self.spark.read.parquet(f"{self.path}/lost/{segment}")
        segments, dirty = dict(state.segments), {t: set(x) for t, x in state.dirty.items()}
        n, size = self._derive(wanted, fresh, lost, segment, segments, dirty)
        if lost is not None and "levels" in wanted:
            n -= gone.where(X.has_token(F.col("text"))).count()
            size -= lost.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
        covered = {t: segment if t in wanted or v == state.version else v for t, v in {**dict.fromkeys(wanted, -1), **state.covered}.items()}
        self.sources.write.mode("overwrite").parquet(f"{self.path}/sources/{segment}")
        return self._publish(dataclasses.replace(state, version=segment, segments=segments, dirty={t: sorted(x) for t, x in dirty.items()}, n=state.n + n, size=state.size + size, covered=covered))

    def _forget(self, *tables: str) -> Index:
        """The index without what it has of derived tables."""
        state = self.state
        segments, dirty, covered = ({k: v for k, v in x.items() if k not in tables} for x in (state.segments, state.dirty, state.covered))
        return Index(self.spark, self.path, dataclasses.replace(state, segments=segments | {t: {} for t in tables}, dirty=dirty | {t: [] for t in tables}, covered=covered, n=0, size=0))

    def _publish(self, state: State) -> Index:
        _Files(self.spark, self.path).write_new(f"versions/{state.version}.json", json.dumps(dataclasses.asdict(state)))
        return Index(self.spark, self.path, state)

    def _count_sources(self, fresh: DataFrame, old: DataFrame, removed: int, version: int) -> int:
        """Write the row of each source after a batch. Articles that begin or end are told from the places of the batch's articles; only a source that lost its first or last id is counted anew."""
        by_article = lambda rows, sign: rows.groupBy(*ARTICLE).agg((F.count(F.lit(1)) * sign).alias("n"))
        moved = by_article(fresh, 1).unionByName(by_article(old, -1)).groupBy(*ARTICLE).agg(F.sum("n").alias("moved"))
        same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & F.col(f"{a}.source_article_id").eqNullSafe(F.col(f"{b}.source_article_id"))
        if self.state.n_sources:
            before = by_article(self._live(self._read("places", self._buckets_of(moved, *ARTICLE))), 1)
            moved = moved.alias("m").join(before.alias("b"), same("m", "b"), "left").select("m.*", F.coalesce("n", F.lit(0)).alias("n"))
        else:
            moved = moved.withColumn("n", F.lit(0))
        change = moved.groupBy("source").agg(F.sum("moved").alias("chunks"), F.sum((F.col("n") + F.col("moved") > 0).cast("long") - (F.col("n") > 0).cast("long")).alias("articles"))
        ends = fresh.groupBy("source").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
        null = lambda c: F.lit(None).cast(self._chunk_schema()["chunk_id"].dataType).alias(c)
        was = self.sources if self.state.n_sources else fresh.limit(0).select("source", F.lit(0).cast("long").alias("chunk_count"), F.lit(0).cast("long").alias("article_count"), null("min_chunk_id"), null("max_chunk_id"))
        lost = old.groupBy("source").agg(F.min("chunk_id").alias("lost_low"), F.max("chunk_id").alias("lost_high"))
        rows = was.withColumn("side", F.lit(0)).unionByName(change.withColumn("side", F.lit(1)), True).unionByName(ends.withColumn("side", F.lit(1)), True).unionByName(lost.withColumn("side", F.lit(1)), True)
        rows = rows.groupBy("source").agg(
            (F.coalesce(F.sum("chunk_count"), F.lit(0)) + F.coalesce(F.sum("chunks"), F.lit(0))).alias("chunk_count"), (F.coalesce(F.sum("article_count"), F.lit(0)) + F.coalesce(F.sum("articles"), F.lit(0))).alias("article_count"),
            F.least(F.min("min_chunk_id"), F.min("low")).alias("min_chunk_id"), F.greatest(F.max("max_chunk_id"), F.max("high")).alias("max_chunk_id"),
            F.coalesce((F.min("lost_low") <= F.min("min_chunk_id")) | (F.max("lost_high") >= F.max("max_chunk_id")), F.lit(False)).alias("anew"),
        ).where("chunk_count > 0")
        rows.write.mode("overwrite").parquet(f"{self.path}/sources/{version}-open")
        rows = self.spark.read.parquet(f"{self.path}/sources/{version}-open")
        if removed and not rows.where("anew").isEmpty():
            places = self._live(self._read("places")).select("source", "chunk_id").join(old.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh.select("source", "chunk_id"))
            found = places.alias("p").join(rows.where("anew").select("source").alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")), "left_semi").groupBy("source").agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"))
            rows = rows.alias("r").join(found.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source")), "left").select("r.source", "chunk_count", "article_count", F.coalesce("low", "min_chunk_id").alias("min_chunk_id"), F.coalesce("high", "max_chunk_id").alias("max_chunk_id"))
        rows.drop("anew").write.mode("overwrite").parquet(f"{self.path}/sources/{version}")
        return self.spark.read.parquet(f"{self.path}/sources/{version}").count()

    def merge(self) -> Index:
        """The index with one segment a bucket and no dead rows. Only buckets that batches since the last merge touched are rewritten."""
        late = [t for t in DERIVED if self.behind(t) and self.state.covered.get(t, -1) >= 0]
        if late:
            return self.refresh(*late).merge()
        segment, segments = self.state.version + 1, {}
        for table in TABLES:
            touched = [int(k) for k, v in self.state.segments[table].items() if len(v) > 1 or int(k) in self.state.dirty[table]]
            segments[table] = {k: v for k, v in self.state.segments[table].items() if int(k) not in touched}
            if not touched:
                continue
            rows = self._read(table, touched)
            # counts meet by token; all other rows are written by the tasks that read them, in their order
            if table == "totals":
                rows = rows.groupBy("bucket", "token", "source").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).where("docs > 0").sortWithinPartitions("bucket", "token")
            elif table == "levels":
                own = Index(self.spark, self.path, dataclasses.replace(self.state, segments={**self.state.segments, **segments}, dead=[]))
                rows = own._read("postings", touched).groupBy("bucket", "token", "level").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("size").alias("least"))
                rows = rows.sortWithinPartitions("bucket", "token")
            else:
                rows = self._live(rows).drop("segment")
            new = Index(self.spark, self.path, dataclasses.replace(self.state, segments={table: {}}))._put(rows, table, segment)
            segments[table] |= new
        self.sources.write.mode("overwrite").parquet(f"{self.path}/sources/{segment}")
        covered = {t: segment for t, v in self.state.covered.items() if v >= 0}
        return self._publish(dataclasses.replace(self.state, version=segment, segments=segments, dirty={t: [] for t in TABLES}, dead=[], n_dead=0, covered=covered))

    def vacuum(self) -> None:
        """Delete what this version doesn't read. Readers of earlier versions fail afterwards."""
        files = _Files(self.spark, self.path)
        for table in TABLES:
            for bucket in files.names(table):
                if bucket.startswith("bucket="):
                    for segment in files.names(f"{table}/{bucket}"):
                        if int(segment.split("=")[1]) not in self.state.segments[table].get(bucket.split("=")[1], []):
                            files.delete(f"{table}/{bucket}/{segment}")
        for folder, keep in (("dead", {f"segment={s}" for s in self.state.dead}), ("sources", {str(self.state.version)}), ("versions", {f"{self.state.version}.json"}), ("replaced", set()), ("lost", set()), ("again", set())):
            for name in files.names(folder):
                if name not in keep:
                    files.delete(f"{folder}/{name}")

    # -- searches

    def tokens_of(self, *terms: str) -> list[str]:
        """Tokens of terms, one term's after another's, by the same rules as those of texts."""
        return self.spark.range(1).select(F.flatten(F.array(*(X.tokens(F.lit(t)) for t in terms)))).first()[0]

    def _of_tokens(self, table: str, tokens: list[str]) -> DataFrame:
        wanted = sorted(set(tokens)) or [""]
        self._needs(table)
        return self._read(table, self._buckets_of_keys([(t,) for t in wanted], "token string")).where(F.col("token").isin(*wanted))

    def _needs(self, table: str) -> None:
        if self.behind(table):
            raise ValueError(f"{table} of this index are behind its chunks: refresh() it first")

    def postings(self, tokens: list[str]) -> DataFrame:
        """Postings of some tokens: other buckets' folders are pruned, and the token test reaches the scan."""
        return self._live(self._of_tokens("postings", tokens))

    def vocabulary(self) -> DataFrame:
        """token, doc, cnt of all tokens, from kept counts."""
        self._needs("totals")
        rows = self._read("totals").groupBy("token").agg(F.sum("docs").alias("doc"), F.sum("uses").alias("cnt"))
        return rows.where("doc > 0")

    def totals(self, tokens: list[str]) -> DataFrame:
        """token, source, docs, uses: true counts, from no posting if totals are kept."""
        if self.behind("totals"):
            return self.postings(tokens).groupBy("token", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("uses"))
        return self._of_tokens("totals", tokens).groupBy("token", "source").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).where("docs > 0")

    def _phrase(self, rows: DataFrame, tokens: list[str], docs: dict[str, int]) -> DataFrame:
        """chunk_id, source of chunks whose postings have tokens in a row: the rarest token says which postings of the others count."""
        distinct = sorted(set(tokens), key=lambda t: (docs.get(t, 0), t))
        if len(tokens) == 1:
            return rows.select("chunk_id", "source")
        rare = rows.where(F.col("token") == distinct[0])
        near = rare.select("chunk_id")
        near = F.broadcast(near) if docs.get(distinct[0], 0) <= MOST_SENT else near
        rest = rows.where(F.col("token") != distinct[0]).join(near, "chunk_id", "left_semi") if len(distinct) > 1 else rare.limit(0)
        held = _by_chunk(rare.unionByName(rest)).where(F.size("held") == len(distinct))
        return held.withColumn("wanted", F.array(*map(F.lit, tokens))).where(_next_to("held", "wanted")).select("chunk_id", "source")

    def _docs(self, tokens: list[str]) -> dict[str, int]:
        return {r["token"]: r["docs"] for r in self.totals(tokens).groupBy("token").agg(F.sum("docs").alias("docs")).collect()}  # a row per token

    def hits(self, term: str) -> DataFrame:
        """chunk_id, source of chunks that have the term's tokens next to each other; none for a term without tokens."""
        tokens = self.tokens_of(term)
        docs = self._docs(tokens)
        if not tokens or len(docs) < len(set(tokens)):
            return self.postings([""]).select("chunk_id", "source").limit(0)
        return self._phrase(self.postings(tokens), tokens, docs)

    def search(self, term: str, limit: int = 20, snippet_tokens: int = 64) -> DataFrame:
        """Like operators.search.search. Sources are counted in their kept table, and texts are read for the hits that are shown only."""
        n = self.state.n_sources
        shown = S.sample_per_source(self.hits(term), max(2, math.ceil(limit / n)) if n else 2).orderBy("nth", "chunk_id").limit(limit).select("chunk_id", "nth").collect()  # limit rows
        rows = self.rows_of([r["chunk_id"] for r in shown])
        order = F.create_map(*(F.lit(x) for r in shown for x in (r["chunk_id"], r["nth"])))[F.col("chunk_id")] if shown else F.lit(0)
        return rows.withColumns({"nth": order, "rank": F.lit(0.0), "snippet": X.snippet(F.col("text"), snippet_tokens)}).orderBy("nth", "chunk_id")

    def context(self, ids: list, before: int = 2, after: int = 2) -> DataFrame:
        """operators.search.context of a bounded list of chunks: their articles' places say which other rows are read."""
        hits = self.rows_of(ids)
        keys = hits.select(*ARTICLE, F.greatest(F.lit(0), F.col("chunk_index") - before).alias("low"), (F.col("chunk_index") + after).alias("high"))
        places = self._live(self._read("places", self._buckets_of(hits, *ARTICLE)))
        near = (F.col("p.source") == F.col("k.source")) & (F.col("p.source_article_id") == F.col("k.source_article_id")) & F.col("chunk_index").between(F.col("low"), F.col("high"))
        found = [r["chunk_id"] for r in places.alias("p").join(F.broadcast(keys).alias("k"), near, "left_semi").select("chunk_id").collect()]  # before + after + 1 a hit
        return S.context(self.rows_of(found), hits, before, after)

    def article(self, source: str, article: str) -> DataFrame:
        """The chunks of one article, by its place."""
        places = self._live(self._read("places", self._buckets_of_keys([(source, article)], "source string, source_article_id string"))).where((F.col("source") == source) & (F.col("source_article_id") == article))
        return self.rows_of([r["chunk_id"] for r in places.select("chunk_id").collect()]).orderBy("chunk_index")  # one article

    def count_by_source(self, term: str, cap_per_source: int = 1000) -> DataFrame:
        """source, hits (capped), most first.

        Of one token the counts are kept, and no posting is read. Of a phrase, slices of the chunks are read, more at each
        step, for those sources only that are neither at the cap nor can have any more by what their rarest token allows.
        """
        tokens = self.tokens_of(term)
        kept = self.totals(tokens).where(F.lit(bool(tokens)))
        if len(tokens) < 2:
            return kept.select("source", F.least("docs", F.lit(cap_per_source).cast("long")).alias("hits")).orderBy(F.desc("hits"), "source")
        counts = self._grow(tokens, lambda found: {s for s, n in found.items() if n >= cap_per_source})
        kind = self._chunk_schema()["source"].dataType.simpleString()
        rows = [(s, min(n, cap_per_source)) for s, n in counts.items() if n]
        return self.spark.createDataFrame(rows, f"source {kind}, hits long").orderBy(F.desc("hits"), "source")

    def count_hits(self, term: str, cap: int = 10_000) -> int:
        """Hits of a term, at most cap; slices are read until there are as many."""
        tokens = self.tokens_of(term)
        if len(tokens) < 2:
            return min(cap, self._docs(tokens).get(tokens[0], 0)) if tokens else 0
        return min(cap, sum(self._grow(tokens, lambda found: set(found) if sum(found.values()) >= cap else set()).values()))

    def _grow(self, tokens: list[str], full) -> dict:
        """Hits of each source, counted slice by slice; sources that full(hits) names are left out from then on."""
        totals = self.totals(tokens)
        most = totals.groupBy("source").agg(F.min("docs").alias("most"), F.count(F.lit(1)).alias("held")).where(F.col("held") == len(set(tokens)))
        found = {r["source"]: 0 for r in most.select("source").collect()}  # a row per source
        docs, low = self._docs(tokens), 0
        step = max(1, SLICES * STEP_ROWS // max(1, sum(docs.values())))
        while low < SLICES:
            open_ = sorted((s for s in found if s not in full(found)), key=lambda s: (s is None, s))
            if not open_:
                break
            rows = self._of_tokens("postings", tokens).where(F.col("slice").between(low, min(SLICES, low + step) - 1))
            if len(open_) < len(found):
                rows = rows.where(F.col("source").isin(*(s for s in open_ if s is not None)) | (F.col("source").isNull() & F.lit(None in open_)))
            for r in self._phrase(self._live(rows), tokens, docs).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect():
                found[r["source"]] = found.get(r["source"], 0) + r["n"]
            low, step = low + step, 3 * step
        return found

    def ranked(self, terms: list[str], limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """chunk_id, score of operators.corpus.ranked. Levels that can't hold one of the best are left out.

        A first look at the levels of greatest weight gives a score that limit chunks reach. A chunk that isn't under it has each
        term in a level whose bound, with the most that the other terms can add, reaches it; the second look reads those.
        """
        wanted = [t.lower() for t in dict.fromkeys(terms)]
        docs, n = self._docs(wanted), self.state.n
        empty = self.postings([""]).select("chunk_id", F.lit(0.0).alias("score")).limit(0)
        if not wanted or any(t not in docs for t in wanted):
            return empty
        mean = self.state.size / n
        idf = {t: math.log(1 + (n - docs[t] + 0.5) / (docs[t] + 0.5)) for t in wanted}
        levels: dict[str, list] = {t: [] for t in wanted}
        for r in self._of_tokens("levels", wanted).groupBy("token", "level").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).collect():  # LEVELS rows a term
            bound = idf[r["token"]] * r["most"] * (k1 + 1) / (r["most"] + k1 * (1 - b + b * r["least"] / mean))
            levels[r["token"]].append((bound, r["level"], r["n"]))
        best = {t: max(x)[0] for t, x in levels.items()}

        def scored(read: dict[str, set]) -> DataFrame:
            test = F.lit(False)
            for t in wanted:
                test |= (F.col("token") == t) & F.col("level").isin(*sorted(read[t]))
            rows = self._live(self._of_tokens("postings", wanted).where(F.col("level").isin(*sorted(set().union(*read.values()))) & test))
            tf = [F.max(F.when(F.col("token") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(wanted)]
            rows = rows.groupBy("chunk_id").agg(F.max("size").alias("size"), *tf).dropna(subset=[f"tf{i}" for i in range(len(wanted))])
            score = F.lit(0.0)
            for i, t in enumerate(wanted):
                tf, df = F.col(f"tf{i}"), F.lit(docs[t])
                score += F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.lit(mean)))
            return rows.select("chunk_id", score.alias("score")).orderBy(F.desc("score"), "chunk_id").limit(limit)

        every = {t: {x[1] for x in levels[t]} for t in wanted}
        seed, read = SEED_ROWS * limit, {}
        while read != every:
            read = {}
            for t in wanted:
                read[t], met = set(), 0
                for _, level, count in sorted(levels[t], reverse=True):
                    if met < seed:
                        read[t].add(level)
                        met += count
            top = scored(read).collect()  # limit rows
            if len(top) == limit or read == every:
                break
            seed *= 8
        if read == every:
            return self.spark.createDataFrame(top, "chunk_id " + self._chunk_schema()["chunk_id"].dataType.simpleString() + ", score double").orderBy(F.desc("score"), "chunk_id") if top else empty
        reach = top[-1]["score"] - 1e-9
        need = {t: {level for bound, level, _ in levels[t] if bound + sum(x for u, x in best.items() if u != t) >= reach} for t in wanted}
        return scored({t: need[t] | read[t] for t in wanted})

    def count_terms_by_source(self, terms: list[str], cap_per_source: int = 1000) -> DataFrame:
        """term, source, hits (capped): terms of one token from kept counts, all others from one scan of their tokens' postings."""
        known = [t for t in dict.fromkeys(terms) if t.strip()]
        listed = self.spark.createDataFrame([(t,) for t in known], "term string").select("term", X.tokens(F.col("term")).alias("wanted")).where(F.size("wanted") > 0).collect()  # the terms asked for
        single = [(r["term"], r["wanted"][0]) for r in listed if len(r["wanted"]) == 1]
        several = [(r["term"], r["wanted"]) for r in listed if len(r["wanted"]) > 1]
        counts = self.totals([t for _, t in single]).select("token", "source", F.col("docs").alias("hits"))
        counts = counts.join(F.broadcast(self.spark.createDataFrame(single, "term string, token string")), "token").select("term", "source", "hits")
        held = _by_chunk(self.postings(sorted({t for _, w in several for t in w})))
        # chunks meet the few terms through their first token, an equi-join
        first = held.select("chunk_id", "source", "held", F.explode(F.map_keys("held")).alias("token"))
        rows = first.join(F.broadcast(self.spark.createDataFrame(several, "term string, wanted array<string>").withColumn("token", F.col("wanted")[0])), "token").where(_next_to("held", "wanted"))
        counts = counts.unionByName(rows.groupBy("term", "source").agg(F.count(F.lit(1)).alias("hits")))
        return counts.select("term", "source", F.least("hits", F.lit(cap_per_source).cast("long")).alias("hits"))


def _by_chunk(postings: DataFrame) -> DataFrame:
    """chunk_id, source, held: a map from token to positions, of the tokens asked for."""
    return postings.groupBy("chunk_id", "source").agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("held"))


def _next_to(held: str, wanted: str) -> Column:
    """Whether some place has all of wanted in a row."""
    places = F.transform(wanted, lambda t, i: F.transform(F.coalesce(F.try_element_at(held, t), F.array().cast("array<int>")), lambda p: p - i))
    return F.size(F.aggregate(places, F.element_at(places, 1), lambda a, b: F.array_intersect(a, b))) > 0


def follow(stream: DataFrame, path: str, checkpoint: str, deleted_col: str = "deleted"):
    """Apply a stream of changes to the index at a path, then stop: rows of chunks, and the ids of those marked as deleted.

    A batch that is run again has its number, so it changes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        index = open_index(batch.sparkSession, path)
        names = [f.name for f in index._chunk_schema()]
        gone = F.coalesce(F.col(deleted_col), F.lit(False))
        index.apply(number + 1, batch.where(~gone).select(*names), batch.where(gone).select("chunk_id"))  # the build is batch 0

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

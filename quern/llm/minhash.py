"""Near-copies by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of 2**32 places make a whole signature: shingles are placed by the first, and
coordinate k is the least value that the second, circularly shifted by k, gives to any of them. Equal texts are merged
first, by a cryptographic hash. Pairs are compared in buckets of bands: each text first with one head among those that it
meets, in units of bounded size; then buckets that still hold texts of different components are compared whole, block by
block, where two blocks have more than one component. Sets are compared by their words, and only links so confirmed are
joined into components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import words as W
from quern.llm.common import Stored, bound_arrow, mix64, spans_by_bytes, text_bytes
from quern.llm.components import components

CALL_BYTES = 1 << 18
#: A unit that compares texts holds about so many of them and so many bytes, or two such blocks.
BLOCK_SETS = 256
BLOCK_BYTES = 4 << 20
#: A pair at the threshold may fail to meet in any band with this probability.
MISS = 1e-5

_random = np.random.Generator(np.random.Philox(20240229))
BYTE = _random.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.uint64(0xC2B2AE3D27D4EB4F)


def banding(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bands and rows a band: six rows, or fewer where the threshold is low, and as many bands as the miss rate asks for."""
    rows = 6 if threshold >= 0.85 else 5 if threshold >= 0.75 else 3 if threshold >= 0.5 else 1
    return math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999999) ** rows)), rows


def _inverse(odd: np.uint64) -> np.uint64:
    x = int(odd)
    return np.uint64(pow(x, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), out=out)
    return out


class _Powers:
    """Powers of the base and of its inverse, kept between calls."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CALL_BYTES + (1 << 16))
            self.up, self.down = _powers(BASE, size), _powers(_inverse(BASE), size)
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, where words begin and end, and the first word of each row, with the number of words behind."""
    low = W.lower_ascii(raw)
    first, last = W.runs(~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
    return low, first, last, np.searchsorted(first, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, end to end, and their n + 1 offsets.

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09 to 0x0D; a shingle is width words. A row
    with fewer words has one shingle, the sequence of them; a row without words has none. Shingles of one hash in a row
    are compared word by word, so a set has as many hashes as it has shingles.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low, first, last, bounds = _words(raw, offsets)
    words = W.hashes(low, first, last)
    counts = np.diff(bounds)
    shingles = words.copy()
    for k in range(1, width):
        shingles = shingles[:-1] if len(shingles) else shingles
        shingles = shingles * np.uint64(0xFF51AFD7ED558CCD) + words[k : k + len(shingles)]
        shingles = mix64(shingles)
    out, sizes = [], np.zeros(n, np.int64)
    for i in range(n):
        c = counts[i]
        if c >= width:
            at = bounds[i]
            own = shingles[at : bounds[i + 1] - width + 1]
            order = np.argsort(own, kind="stable")
            own = own[order]
            fresh = np.concatenate([[True], own[1:] != own[:-1]])
            if not fresh.all():
                x, y = order[:-1][~fresh[1:]] + at, order[1:][~fresh[1:]] + at
                same = np.ones(len(x), bool)
                for k in range(width):
                    size = last[x + k] - first[x + k]
                    same &= size == last[y + k] - first[y + k]
                    same &= W.equal(low, first[x + k], first[y + k], np.where(same, size, 0))
                if not same.all():
                    own, fresh = _hashes_by_words(low, first[at : bounds[i + 1]], last[at : bounds[i + 1]], width), slice(None)
            own = own[fresh]
        elif c:
            h = np.full(1, c, np.uint64)
            for w in words[bounds[i] : bounds[i + 1]]:
                h = mix64(h * np.uint64(0xC4CEB9FE1A85EC53) + w)
            own = h
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _hashes_by_words(low: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """A hash for each distinct shingle of one row, told apart by its words; the way out where two have one hash."""
    words = [low[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    distinct = {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
    found: set[int] = set()
    for x in sorted(distinct):
        h = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")
        while h in found:
            h = (h + 1) % (1 << 64)
        found.add(h)
    return np.array(sorted(found), np.uint64)


def exact_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The shingle sets of a unit's rows as sorted numbers, equal just where the shingles' words are."""
    low, first, last, bounds = _words(raw, offsets)
    pick, word = W.names(low, first, last)
    kinds, shingle = len(pick) + 1, word.astype(np.int64)
    for k in range(1, width):
        shingle = shingle[:-1] if len(shingle) else shingle
        shingle = np.unique(shingle * kinds + word[k : k + len(shingle)], return_inverse=True)[1].astype(np.int64)
    out, short = [], {}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingle[a : b - width + 1]))
        else:
            # a sequence of fewer words is a shingle of its own, numbered from -1 down
            out.append(np.array([-1 - short.setdefault(tuple(word[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out


def signatures(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Circulant MinHash signatures (rows x length) of non-empty sets that begin at starts."""
    place = (mix64(shingles * PLACES) >> np.uint64(32)).astype(np.uint32)  # the first permutation, on the hashed universe
    out = np.empty((len(starts), length), np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(length):
        np.subtract(place, np.uint32(k), out=x)  # the circular shift
        for multiplier, shift in ((0x85EBCA6B, 15), (0xC2B2AE35, 13), (0x27D4EB2F, 16)):  # the second permutation
            np.multiply(x, np.uint32(multiplier), out=x)
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, which holds the band's number."""
    grid = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * BASE, grid.shape[:2]).copy()
    for r in range(rows):
        key = mix64(key * np.uint64(0xFF51AFD7ED558CCD) + grid[:, :, r])
    return key.view(np.int64)


def _features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, name (of the text), n, size (bytes of the text), keys of the bands. docs: id, text, name."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for lo, hi in spans_by_bytes(offsets, CALL_BYTES):
                o = offsets[lo : hi + 1]
                s, at = shingle_sets(raw[o[0] : o[-1]], o - o[0], width)
                n = np.diff(at)
                full = np.flatnonzero(n)
                width_of = np.zeros(hi - lo + 1, np.int32)
                keys = np.zeros(0, np.int64)
                if len(full):
                    keys = band_keys(signatures(s, at[:-1][full], bands * rows), bands, rows).ravel()
                    width_of[1:][full] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(width_of, dtype=np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n), pa.array(np.diff(o)), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block's sets, exactly."""
    m = len(sets)
    out = np.zeros((m, m), np.float64)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    name = np.cumsum(new) - 1
    several = np.bincount(name)[name] > 1
    name, owner = name[several], owner[several]
    if len(name):
        name = np.cumsum(np.concatenate([[False], name[1:] != name[:-1]]))
        step = max(1, (8 << 20) // (4 * m))
        for lo in range(0, int(name[-1]) + 1, step):
            a, b = np.searchsorted(name, [lo, lo + step])
            grid = np.zeros((m, min(step, int(name[-1]) + 1 - lo)), np.float32)
            grid[owner[a:b], name[a:b] - lo] = 1
            out += grid @ grid.T
    out[np.arange(m), np.arange(m)] = [len(s) for s in sets]
    return out


def linked(sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None) -> np.ndarray:
    """For each set of a block, the place of the first set that links reach. cross: only pairs of different sides."""
    both, n = _shared(sets), np.array([len(s) for s in sets], np.float64)
    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    if cross is not None:
        link &= cross[:, None] != cross[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(len(sets))
    while True:
        least = np.where(link, label[None, :], len(sets)).min(axis=1)
        least = np.minimum(least, label[least])
        if (least == label).all():
            return label
        label = least


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Result: id_col, n_shingles long (size of the set), component_id (smallest id reachable over links, itself
    included), kept boolean (it is that smallest id), a row per input row. Links are confirmed on full sets, word by
    word; a pair at the threshold is a candidate with probability 1 - MISS at least, and rows of one text are merged
    before and never missed.

    Null and empty texts have no shingles and are linked with nothing. A null id can't name a component: such a row
    has a null component_id and is kept. Rows that repeat an id are linked by their own texts each, and share the id.
    Of ids that tie for the smallest, all rows with it are kept. A very long text is one set, and a unit by itself if it
    has more than BLOCK_BYTES. Other columns are not read. An empty table gives no rows.
    """
    rows = _components(docs, id_col, text_col, width, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _name(text) -> Column:
    """Names of texts: the first 128 bits of their SHA-256; null has an empty one."""
    return F.coalesce(F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)), F.lit(b""))


def _blocks(m, size):
    """How many blocks hold m texts of size bytes in all."""
    return F.greatest(F.lit(1), F.least(m, F.ceil(F.greatest(m / BLOCK_SETS, size / BLOCK_BYTES)))).cast("long")


def _compare(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links a, b inside units (u, i, j, own, node): all pairs where i = j, else pairs of blocks own = i and own = j."""

    def run(key, block):
        block = block.combine_chunks().sort_by("node")
        raw, offsets = text_bytes(block.column("text"))
        side = None if key[1].as_py() == key[2].as_py() else block.column("own").to_numpy()
        label = linked(exact_sets(raw, offsets, width), percent, side)
        apart = np.flatnonzero(label != np.arange(len(label)))
        node = block.column("node").to_numpy()
        return pa.table([pa.array(node[apart]), pa.array(node[label[apart]])], names=["a", "b"])

    return units.join(texts, "node").groupBy("u", "i", "j").applyInArrow(run, "a long, b long")


def _stars(met: DataFrame, nodes: DataFrame, head) -> DataFrame:
    """node, head, chunk, chunks: each text with one of the heads that it meets, heads' texts dealt over chunks."""
    pairs = met.where("node <> head").groupBy("node").agg(head("head").alias("head"))
    sizes = pairs.join(nodes.select("node", "size"), "node").groupBy("head").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("chunks"))
    return pairs.join(sizes, "head").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))


def _star_units(stars: DataFrame) -> DataFrame:
    """A unit per chunk of a head: its texts and the head."""
    zero = F.lit(0).cast("long")
    heads = stars.select("head", "chunks").distinct().select(F.col("head").alias("u"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("i"), F.col("head").alias("node"))
    return stars.select(F.col("head").alias("u"), F.col("chunk").alias("i"), "node").unionByName(heads).select("u", "i", F.col("i").alias("j"), F.col("i").alias("own"), "node")


def _rest(met: DataFrame, roots: DataFrame, stars: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units of buckets that hold several components and that no unit of stars compared whole.

    A bucket's texts are dealt to blocks; two blocks make a unit if they hold more than one component.
    """
    rows = met.join(roots, "node").join(stars.select("node", F.col("head").alias("star"), "chunk"), "node", "left").join(nodes.select("node", "size"), "node")
    other = F.col("node") != F.col("head")
    same = lambda c: F.min(F.when(other, c)) == F.max(F.when(other, c))
    done = same(F.col("star")) & same(F.col("chunk")) & (F.min(F.when(other, F.col("star"))) == F.min("head")) & (F.count(F.when(other, F.col("star"))) == F.count_if(other))
    open_ = rows.groupBy("key").agg(_blocks(F.count(F.lit(1)), F.sum("size")).alias("blocks"), (F.min("root") != F.max("root")).alias("several"), F.coalesce(done, F.lit(False)).alias("done"))
    open_ = open_.where("several and not done").select("key", "blocks")
    rows = rows.join(open_, "key").select(F.col("key").alias("u"), "node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
    held = rows.groupBy("u", "blocks", "own").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    zero = F.lit(0).cast("long")
    pairs = held.select("u", "own", "low", "high", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("u", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "low", "high")
    units = pairs.groupBy("u", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("u", "i", "j")
    sides = units.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    return rows.select("u", "own", "node").join(sides, ["u", "own"]).select("u", "i", "j", "own", "node")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, name (of the text), n, component_id, kept and first of each row.

    first is the (id, name) of the component's row that stays where one does: of smallest id, then of smallest name; null
    where there is no set or no id.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    store = Stored(spark, "near-copies")
    bands, rows = banding(percent / 100)
    text = docs[text_col].cast("string")
    read = docs.select(docs[id_col].alias("id"), text.alias("text"), _name(text).alias("name"))
    seen = store.keep(_features(read, width, bands, rows), "features")
    named = seen.where(F.col("id").isNotNull() & (F.col("n") > 0))
    nodes = named.groupBy("name").agg(F.min(F.struct("id", "n", "size", "keys")).alias("x")).select(F.monotonically_increasing_id().alias("node"), "name", "x.*")
    nodes = store.keep(nodes, "nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    heads = placed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    met = store.keep(placed.join(heads, "key").select("key", "node", "head", "last"), "met")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "id", "name")
    texts = store.keep(read.join(wanted, ["id", "name"]).dropDuplicates(["id", "name"]).select("node", "text"), "texts")
    stars = store.keep(_stars(met, nodes, F.min), "stars")
    links = store.keep(_compare(_star_units(stars), texts, width, percent), "links-0")
    every = nodes.select("node")
    # what a head linked shares its root, or the root of that: enough to tell which texts needn't meet again
    near = lambda c, r: links.select(F.col("a").alias(c), F.col("b").alias(r))
    root = every.join(near("node", "up"), "node", "left").join(near("up", "top"), "up", "left").select("node", F.coalesce("top", "up", "node").alias("root"))
    root = store.keep(root, "roots")
    more = store.keep(_compare(_rest(met, root, stars, nodes), texts, width, percent), "links-1")
    joined = components(links.unionByName(more), "a", "b", store, "all")
    root = every.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    found = nodes.select("node", "name", "id").join(root, "node")
    least = found.groupBy("root").agg(F.min(F.struct("id", "name")).alias("first"))
    found = store.keep(found.join(least, "root").select("name", "first"), "found")
    out = seen.drop("keys", "size").join(found, "name", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first.id", "id"))
    return out.select("id", "name", "n", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.when(F.col("id").isNotNull(), F.col("first")).alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each component of near_copies: of the rows with the smallest id, one.

    Rows with a null id stay. Of rows that repeat the id that stays, one of the text with the least hash is kept.
    """
    # of each id that stays, one text; only ids and names are grouped
    one = _components(docs, id_col, text_col, width, percent).where("kept and id is not null").groupBy("id", "name").agg(F.count(F.lit(1)).alias("copies"))
    one = one.groupBy("id").agg(F.min(F.struct("name", "copies")).alias("x")).select("id", "x.name", "x.copies")
    return _staying(docs, one, id_col, text_col)


def keep_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each group of linked texts: that of the smallest id, then of the least text hash.

    Rows with a null id stay. Texts of one id that aren't linked are groups of their own, so each of them stays; of rows
    that repeat id and text one does.
    """
    found = _components(docs, id_col, text_col, width, percent).where(F.col("id").isNotNull())
    own = found.where(F.coalesce(F.col("first") == F.struct("id", "name"), F.lit(True)))
    return _staying(docs, own.groupBy("id", "name").agg(F.count(F.lit(1)).alias("copies")), id_col, text_col)


def _staying(docs: DataFrame, one: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row of docs for each id and name of one, which has copies rows, and those with a null id."""
    named = docs.select(F.struct(*docs.columns).alias("row"), docs[id_col].alias("id"), _name(docs[text_col].cast("string")).alias("name"))
    one = one.select(F.col("id").alias("of"), F.col("name").alias("of_name"), "copies")
    stays = named.join(one, (F.col("id") == F.col("of")) & (F.col("name") == F.col("of_name")))
    single, several = stays.where("copies = 1"), stays.where("copies > 1").dropDuplicates(["id", "name"])
    rows = single.select("row").unionByName(several.select("row")).unionByName(named.where("id is null").select("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

"""A trie of conversation prefixes, hash-partitioned by first turn, with pointer dictionaries inside each part.

Turns go by a digest of role and text, so no text is shuffled; a prefix goes by a digest chained over its turns.
Conversations of one sequence are merged and counted first. The subtrie of a first turn is built whole in one task, several
to a bucket of a hash; one of more than SUBTRIE_TURNS turns is dealt by its next turn instead, again and again, and the
nodes above such cuts are added up from their children by aggregates.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Stored, bound_arrow

#: Conversations form groups of this many ids, and take at most one turn less than MOST_SHARED from the first of a group.
GROUP, MOST_SHARED = 5, 9
#: Turns of one subtrie that a task builds whole, and turns that a bucket of subtries is sized for.
SUBTRIE_TURNS = 4_096
BUCKET_TURNS = 16_384
#: Nodes above cuts are sent to all tasks while they are no more than this, and joined beyond.
MOST_SENT = 200_000
#: Ids of members that one block of a node's list holds.
BLOCK_IDS = 4_096
#: The key of the root, and bytes of the keys of other nodes.
ROOT, KEY_BYTES = b"", 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn: bytes of the role, a colon, role, text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY_BYTES))


def rebuilt(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, shared: int = MOST_SHARED) -> DataFrame:
    """conv, keys (of its prefixes from one turn on), sizes (bytes of its texts), key (of its whole sequence) of each rebuilt conversation.

    Conversations of a group meet in one row, as digests and sizes of their turns.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    conv = conversations[id_col].cast("long")
    taken = (F.crc32(conv.cast("string")) % shared).cast("int")
    turns = conversations.select(conv.alias("conv"), conversations[turn_col].cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("size"), taken.alias("taken")).where("conv is not null")
    groups = turns.groupBy((F.col("conv") - F.col("conv") % group).alias("base")).agg(F.collect_list(F.struct("conv", "turn", "digest", "size", "taken")).alias("turns"))

    def run(batches):
        for batch in batches:
            for base, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = turns.values
                own: dict[int, list] = {}
                columns = (flat.field(k).to_pylist() for k in range(5))
                for conv, turn, digest, size, taken in sorted(zip(*columns, strict=True), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2])):
                    own.setdefault(conv, [taken, []])[1].append((digest, size))
                first = own.get(base, (0, []))[1]
                for some in _chunks(own.items(), BLOCK_IDS):
                    ids, keys, sizes, last = [], [], [], []
                    for conv, (taken, turns) in some:
                        key, chain = ROOT, []
                        both = first[:taken] + turns[taken:]
                        for digest, _ in both:
                            key = hashlib.sha256(key + digest).digest()[:KEY_BYTES]
                            chain.append(key)
                        ids.append(conv)
                        keys.append(chain)
                        sizes.append([size for _, size in both])
                        last.append(key)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64())), pa.array(last, pa.binary())], names=["conv", "keys", "sizes", "key"])

    return groups.mapInArrow(run, "conv long, keys array<binary>, sizes array<long>, key binary")


def _chunks(items, size: int):
    some = []
    for x in items:
        some.append(x)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


def ends(members: DataFrame) -> DataFrame:
    """key, ends_sha256 of members (conv, key): ids of each key in order, as decimals joined by commas.

    Ids are sorted over all tasks and joined to blocks there; a hash reads its text in order, so one task reads the
    blocks of a key one after another, without holding them.
    """

    def blocks(batches):
        key, ids, out = None, [], []

        def close():
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def sent():
            found = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["key", "low", "ids"])
            out.clear()
            return found

        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key or len(ids) == BLOCK_IDS:
                    close()
                    key = k
                ids.append(conv)
            yield sent()
        close()
        yield sent()

    def hashed(batches):
        key, sha = None, None
        for batch in batches:
            keys, shas = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    order = members.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    parts = order.mapInArrow(blocks, "key binary, low long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "low").mapInArrow(hashed, "key binary, ends_sha256 string")


NODE = "key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _build(table: pa.Table) -> pa.Table:
    """All nodes of a bucket's subtries. Rows are sequences: level and parent of the subtrie's top, keys and sizes from there on, n, conv."""
    nodes: list[list] = []  # key, parent's key, depth, conv_id, parent's place or -1, n_convs, children by key, size
    tops: dict[bytes, int] = {}
    columns = (table.column(c).to_pylist() for c in ("level", "parent", "keys", "sizes", "n", "conv"))
    for level, parent, keys, sizes, n, conv in zip(*columns, strict=True):
        at, up, children = -1, parent, tops
        for k, (key, size) in enumerate(zip(keys, sizes, strict=True)):
            here = children.get(key)
            if here is None:
                here = children[key] = len(nodes)
                nodes.append([key, up, level + k, conv, at, 0, {}, size])
            node = nodes[here]
            node[5] += n
            node[3] = min(node[3], conv)
            at, up, children = here, key, node[6]
    leaves, saved, stack = [0] * len(nodes), [0] * len(nodes), [(top, False) for top in tops.values()]
    while stack:  # postorder: a node is closed when its children are
        at, closed = stack.pop()
        node = nodes[at]
        if closed:
            below = node[6].values()
            leaves[at] = sum(leaves[c] for c in below) or 1
            saved[at] = (node[5] - 1) * node[7] + sum(saved[c] for c in below)
        else:
            stack.append((at, True))
            stack.extend((c, False) for c in node[6].values())
    parent_conv = [None if n[4] < 0 else nodes[n[4]][3] for n in nodes]
    long = lambda x: pa.array(x, pa.int64())
    return pa.table(
        [pa.array([n[0] for n in nodes], pa.binary()), pa.array([n[1] for n in nodes], pa.binary()), long([n[2] for n in nodes]), long([n[3] for n in nodes]), long(parent_conv),
         long([n[5] for n in nodes]), long([len(n[6]) for n in nodes]), long(leaves), long(saved)],
        names=[c.split(" ")[0] for c in NODE.split(", ")],
    )


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = GROUP, shared: int = MOST_SHARED, subtrie_turns: int = SUBTRIE_TURNS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation stand by turn, null first, then by the digest of role and text. Conversation c takes its first h
    turns from conversation c - c % group (all if it has fewer, none if there is none), h = crc32(c) % shared, and goes on with
    its own after its first h. A node is a distinct sequence of first turns (role and text; null counts as empty); conv_id
    is the smallest conversation that starts with it, n_convs how many do, ends_sha256 tells those that end there.

    Rows with a null id belong to no conversation and are left out. Repeated rows are turns like others. A turn in a hot group
    of equal conversations is counted once, with their number. A very long text is a digest and a size; a conversation's
    digests must fit into a row (some 80 million turns). Extra columns are not read. An empty table has no root and gives no rows.
    """
    spark = conversations.sparkSession
    bound_arrow(spark)
    store = Stored(spark, "trie")
    read = store.keep(rebuilt(conversations, id_col, turn_col, role_col, text_col, group, shared), "rebuilt")
    every, least = read.agg(F.count(F.lit(1)), F.min("conv")).first()
    if not every:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    sequences = read.where(F.size("keys") > 0).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes"))
    open_ = store.keep(sequences.drop("key"), "sequences")
    placed, upper, level = [], [], 0
    while True:
        level += 1
        at = lambda c, k: F.element_at(c, F.lit(k))
        open_ = open_.where(F.size("keys") >= level).withColumn("top", at("keys", level))
        parent = at("keys", level - 1) if level > 1 else F.lit(ROOT)
        size = F.size("keys") - level + 1
        tops = open_.groupBy("top").agg(F.sum(size.cast("long")).alias("turns"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.first(parent).alias("parent"), F.first(at("sizes", level)).alias("size"))
        large = store.keep(tops.where(F.col("turns") > subtrie_turns), f"large-{level}")
        many = large.count()
        cut = F.broadcast(large.select("top")) if many <= MOST_SENT else large.select("top")
        rows = open_.join(cut, "top", "left_anti") if many else open_
        placed.append(rows.select("top", F.lit(level).cast("long").alias("level"), parent.alias("parent"), F.expr(f"slice(keys, {level}, size(keys))").alias("keys"), F.expr(f"slice(sizes, {level}, size(sizes))").alias("sizes"), "n", "conv"))
        if not many:
            break
        upper.append((level, large, many))
        open_ = store.keep(open_.join(cut, "top", "left_semi").drop("top"), f"open-{level}")
    rows = placed[0]
    for more in placed[1:]:
        rows = rows.unionByName(more)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = read.agg(F.sum(F.size("keys").cast("long"))).first()[0]
    buckets = max(tasks, -(-turns // BUCKET_TURNS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("top"), F.lit(buckets))).drop("top")
    built = store.keep(rows.groupBy("bucket").applyInArrow(_build, NODE), "built")

    # nodes above the cuts, from the deepest up, by their children
    nodes, sent = [], 1
    below = built.where("parent_conv_id is null")
    for level, large, many in reversed(upper):
        sums = below.where(F.col("depth") == level + 1).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        found = large.join(sums.withColumnRenamed("parent", "top"), "top")
        found = found.select(F.col("top").alias("key"), "parent", F.lit(level).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
        nodes.append(store.keep(found, f"upper-{level}"))
        below, sent = below.unionByName(nodes[-1]), sent + many
    root = below.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    none = F.lit(None).cast("long")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("conv_id"), none.alias("parent_conv_id"), F.lit(every).cast("long").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens")
    all_ = root.unionByName(built)
    names = None
    for more in nodes:
        all_ = all_.unionByName(more)
        own = more.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
        names = own if names is None else names.unionByName(own)
    if names is not None:
        all_ = all_.join(F.broadcast(names) if sent <= MOST_SENT else names, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).drop("up")
    # tops of first turns are children of the root
    all_ = all_.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    out = all_.join(store.keep(ends(read.select("conv", "key")), "ends"), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))

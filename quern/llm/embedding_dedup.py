"""Near-copies of embeddings by robust-pruned graphs on overlapping cluster shards.

Equal vectors are merged first. Vectors go to the shards of their nearest centroids, large clusters being dealt over
several blocks; each shard's graph keeps, per vector, neighbours that no kept neighbour is much nearer to. The lists of
a vector from all its shards are united into one flat graph. Searches start from a shard's medoid (and, for a vector of
the shard, from itself), walk greedily, and then expand everything in range. What they find is verified in double
precision, and the recall of a bounded set of queries is audited against brute force. Under the bar, vectors go to twice
as many shards, and at last every vector is compared with every other.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Stored, bound_arrow
from quern.llm.components import components
from quern.llm.fitting import hashed_sample

#: Vectors of a block of a cluster, about; centroids at most; vectors that they are fitted on, at least and per centroid.
SHARD_ROWS, MOST_CLUSTERS, SAMPLE_ROWS, SAMPLE_EACH = 600, 16_384, 20_000, 8
#: More centroids than this are fitted in two levels.
FLAT_CLUSTERS = 512
#: Shards of a vector; neighbours kept by pruning; candidates looked at; how much nearer a kept neighbour must be to prune.
OVERLAP, DEGREE, POOL, ALPHA = 3, 20, 64, 1.2
#: Nodes that a greedy search keeps, and how far below the range a node may lie and still be expanded.
BEAM, SLACK = 16, 0.03
#: Queries of the audit at first, and the recall under which vectors go to twice as many shards.
AUDIT_ROWS, LEAST_RECALL = 512, 0.98
#: The audit draws more queries, up to so many bytes of them, until so many have a link, but not more than so many links.
AUDIT_BYTES, AUDIT_LINKED, FEW_LINKS = 8 << 20, 128, 16
#: Vectors of a block where all are compared with all.
EXACT_ROWS = 2048


def _means(x: np.ndarray, k: int, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    c = x[np.sort(random.choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c, (x @ c.T).argmax(1)


def centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; many centroids are fitted inside coarse clusters, in proportion to their sizes."""
    if k <= FLAT_CLUSTERS:
        return _means(x, k, seed, rounds)[0]
    coarse, near = _means(x, int(np.ceil(np.sqrt(k))), seed, rounds)
    parts = [x[near == i] for i in range(len(coarse))]
    return np.concatenate([_means(p, max(1, round(k * len(p) / len(x))), seed, rounds)[0] for p in parts if len(p)])


def prune(x: np.ndarray, seed: int = 1) -> list[np.ndarray]:
    """Neighbours of each unit vector of a shard, by robust pruning of its nearest and of some random ones; all reachable from the medoid."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    sims = x @ x.T
    pool = min(POOL, m - 1)
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
    far = np.random.default_rng(seed).integers(0, m, (m, 16))
    pool_of = np.concatenate([near, far], axis=1)
    own = np.take_along_axis(sims, pool_of, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    pool_of, own = np.take_along_axis(pool_of, order, 1), np.take_along_axis(own, order, 1)
    np.fill_diagonal(sims, 1)
    distance = lambda s: np.sqrt(np.maximum(0, 2 - 2 * s))
    kept, n, rows = np.zeros((m, DEGREE), np.int64), np.zeros(m, np.int64), np.arange(m)
    for j in range(pool_of.shape[1]):
        c = pool_of[:, j]
        nearer = (ALPHA * distance(sims[kept, c[:, None]]) <= distance(own[:, j])[:, None]) & (np.arange(DEGREE) < n[:, None])
        take = ~nearer.any(1) & (n < DEGREE) & (c != rows)
        kept[rows[take], n[take]] = c[take]
        n[take] += 1
    source, target = np.repeat(rows, n), kept[np.arange(DEGREE) < n[:, None]]
    # edges both ways; a node keeps the nearest of those that point back to it
    back = np.lexsort((-sims[target, source], target))
    first = np.searchsorted(target[back], rows)
    rank = np.arange(len(back)) - first[target[back]]
    back = back[rank < 2 * DEGREE]
    a, b = np.concatenate([source, target[back]]), np.concatenate([target, source[back]])
    # reach: link what can't be reached to the nearest that can
    start = medoid(x)
    while True:
        seen, front = np.zeros(m, bool), np.array([start])
        seen[front] = True
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        bounds = np.searchsorted(a, np.arange(m + 1))
        while len(front):
            step = np.unique(np.concatenate([b[bounds[i] : bounds[i + 1]] for i in front]))
            front = step[~seen[step]]
            seen[front] = True
        if seen.all():
            break
        left, right = np.flatnonzero(seen), np.flatnonzero(~seen)
        best = np.unravel_index(sims[np.ix_(left, right)].argmax(), (len(left), len(right)))
        a, b = np.append(a, [left[best[0]], right[best[1]]]), np.append(b, [right[best[1]], left[best[0]]])
    return [np.unique(b[bounds[i] : bounds[i + 1]]) for i in range(m)]


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def search(x: np.ndarray, near: list[np.ndarray], q: np.ndarray, starts, least: float) -> np.ndarray:
    """Places of unit vectors that a search for q finds with a cosine of about least or more.

    Greedy best-first steps go on until the BEAM nearest nodes seen are expanded; then all nodes in range, a
    little slack included, are expanded together until nothing new is in range.
    """
    seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
    sims = np.full(len(x), -2.0)
    starts = np.unique(starts)
    seen[starts] = True
    sims[starts] = x[starts] @ q
    heap, top = [(-sims[s], int(s)) for s in starts], []
    heapq.heapify(heap)
    while heap:
        minus, node = heapq.heappop(heap)
        if len(top) >= BEAM and -minus < top[0] or -minus >= least - SLACK:
            break
        done[node] = True
        new = near[node]
        new = new[~seen[new]]
        if len(new):
            seen[new] = True
            sims[new] = x[new] @ q
            for s, k in zip(sims[new].tolist(), new.tolist(), strict=True):
                if len(top) < BEAM or s > top[0]:
                    heapq.heappush(heap, (-s, k))
                    heapq.heappush(top, s)
                    if len(top) > BEAM:
                        heapq.heappop(top)
    while True:
        front = np.flatnonzero((sims >= least - SLACK) & ~done)
        if not len(front):
            return np.flatnonzero(sims >= least - 1e-9)
        done[front] = True
        new = np.unique(np.concatenate([near[i] for i in front]))
        new = new[~seen[new]]
        seen[new] = True
        sims[new] = x[new] @ q


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


LONG = T.LongType()


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct usable vectors: key, v (components as doubles), mult."""

    def run(batches):
        for batch in batches:
            v = [np.asarray(x.as_py(), np.float64).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary())], names=["key", "v"])

    named = rows.where("key is not null").groupBy("key", "check").agg(F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")).drop("check")
    packed = named.select("key", "embedding").mapInArrow(run, _schema(key=LONG, v=T.BinaryType()))
    return packed.join(named.select("key", "mult"), "key")


def _keyed(rows: DataFrame, store: Stored) -> tuple[DataFrame, DataFrame]:
    """rows and their nodes, a key for each distinct vector: where two hashes tell vectors of one key apart, they get keys of both.

    Of ten billion vectors two or three share a key.
    """
    attempt = 0
    while True:
        counts = store.keep(rows.where("key is not null").select("key", "check").distinct().groupBy("key").count().where("count > 1").select("key"), f"clashes-{attempt}")
        if counts.isEmpty():
            return rows, store.keep(_nodes(rows), "nodes")
        clash = counts.withColumn("clash", F.lit(True))
        rows = rows.join(clash, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64("check", "key")).otherwise(F.col("key"))).drop("clash")
        rows, attempt = store.keep(rows, f"rows-{attempt + 1}"), attempt + 1


def _assign(nodes: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """A row per node and shard: cluster, and before, the node's clusters of smaller number."""
    k = min(overlap, len(c))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_vectors(batch.column(1)))
            step = max(1, (1 << 22) // max(1, len(c)))
            order = np.concatenate([np.argsort(-(unit[lo : lo + step] @ c.T), axis=1, kind="stable")[:, :k] for lo in range(0, len(unit), step)])
            order = np.sort(order, axis=1).astype(np.int64)
            # a vector's clusters one after another, so that batches stay as large as they were however many there are
            for j in range(k):
                before = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * j), pa.array(order[:, :j].ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(order[:, j]), before], names=["key", "v", "mult", "cluster", "before"])

    return nodes.select("key", "v", "mult").mapInArrow(run, _schema(key=LONG, v=T.BinaryType(), mult=LONG, cluster=LONG, before=T.ArrayType(LONG)))


def _build(block):
    """Graph of a shard: a row per member with its neighbours' keys."""
    keys = block.column("key").to_numpy()
    order = np.argsort(keys)
    keys = keys[order]
    near = prune(_unit(_vectors(block.column("v").combine_chunks().take(pa.array(order)))))
    return pa.table([pa.array(keys), pa.array([keys[n] for n in near], pa.list_(pa.int64()))], names=["key", "near"])


def _met(before) -> np.ndarray:
    """Which members of a unit share a cluster of smaller number, where their pair is met already."""
    sizes = np.diff(before.offsets.to_numpy())
    _, cluster = np.unique(before.flatten().to_numpy(), return_inverse=True)
    if not len(cluster):
        return np.zeros((len(sizes), len(sizes)), bool)
    grid = np.zeros((len(sizes), cluster.max() + 1), np.float32)
    grid[np.repeat(np.arange(len(sizes)), sizes), cluster] = 1
    return grid @ grid.T > 0


def _search(least: float, exact: bool):
    def run(unit_key, block):
        """Links of a unit's members (n with copies, d without), and edges that join what they link. exact: all are compared.

        A unit is one block of a cluster, or two whose members meet each other. Each member looks for its links, and
        what one finds counts for both; a pair counts in the first cluster that both are members of, and nowhere else.
        """
        block = block.combine_chunks()
        block = block.take(pa.array(np.lexsort((block.column("key").to_numpy(), block.column("block").to_numpy()))))
        keys, side = block.column("key").to_numpy(), block.column("block").to_numpy()
        raw = _vectors(block.column("v").combine_chunks())
        unit, mult, norm = _unit(raw), block.column("mult").to_numpy(), np.sqrt((raw * raw).sum(1))
        lists = None if exact else block.column("near").to_pylist()
        link = np.zeros((len(keys), len(keys)), bool)
        i, j = (k.as_py() for k in unit_key[1:])
        for of in (i, j) if i < j else (i,):
            # the members of one block are looked for, by those of the other or by themselves
            own = np.flatnonzero(side == of)
            asking = np.flatnonzero(side != of) if i < j else own
            if not len(own) or not len(asking):
                continue
            low, x = own[0], unit[own]
            if not exact:
                places = {k: p for p, k in enumerate(keys[own].tolist())}
                near = [np.array([places[k] for k in lists[p] if k in places], np.int64) for p in own]
                start = [medoid(x)]
            for p in asking.tolist():
                if exact:
                    found = np.flatnonzero(x @ unit[p] >= least - 1e-9)
                else:
                    found = search(x, near, unit[p], np.array(start if i < j else [*start, p - low]), least)
                found = found[found != p - low] + low
                cosine = (raw[found] * raw[p]).sum(1) / (norm[found] * norm[p])
                link[p, found[cosine >= least]] = True
        link |= link.T
        link &= ~_met(block.column("before").combine_chunks())
        n = link.sum(1)
        some = np.flatnonzero(n)
        link, keys = link[np.ix_(some, some)], keys[some]
        label = np.arange(len(some))
        while len(some):
            lower = np.minimum(label, np.where(link, label[None, :], len(some)).min(1))
            lower = np.minimum(lower, lower[lower])
            if (lower == label).all():
                break
            label = lower
        other = pa.array(keys[label], pa.int64(), mask=label == np.arange(len(some)))
        return pa.table([pa.array(keys, pa.int64()), other, pa.array(link @ mult[some], pa.int64()), pa.array(n[some], pa.int64())], names=["key", "other", "n", "d"])

    return run


def _true_links(nodes: DataFrame, queries: DataFrame, least: float) -> dict[int, int]:
    """Distinct vectors linked to each of a bounded set of queries, by brute force over all nodes."""
    got = queries.select("key", "v").toArrow().combine_chunks()
    keys, raw = got.column(0).to_numpy(), _vectors(got.column(1).combine_chunks())
    norm = np.sqrt((raw * raw).sum(1))

    def run(batches):
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _vectors(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            size = np.sqrt((x * x).sum(1))
            for lo in range(0, len(keys), 512):
                part = slice(lo, lo + 512)
                hit = (raw[part] @ x.T) / (norm[part, None] * size) >= least
                total[part] += (hit & (keys[part, None] != own)).sum(1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(total[some])], names=["key", "n"])

    found = nodes.select("key", "v").mapInArrow(run, _schema(key=LONG, n=LONG)).groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in found.collect()}


def _audit(nodes: DataFrame, n: int, wide: int, least: float, store: Stored, label: str) -> tuple[DataFrame, dict[int, int], bool]:
    """Queries, the linked ones' numbers of distinct neighbours, and whether the queries are all n nodes.

    More are drawn until AUDIT_LINKED of them have a link and lie outside hot groups, or AUDIT_BYTES hold no more.
    """
    rows, most = AUDIT_ROWS, max(AUDIT_ROWS, AUDIT_BYTES // (8 * wide))
    while True:
        queries = store.keep(hashed_sample(nodes, F.col("key"), rows, 29), f"audit-{label}-{rows}")
        truth = _true_links(nodes, queries, least)
        if rows >= min(n, most) or sum(t <= FEW_LINKS for t in truth.values()) >= AUDIT_LINKED:
            return queries, truth, rows >= n
        rows = min(4 * rows, most)


def audited_recall(truth: dict[int, int], seen: dict[int, int]) -> float | None:
    """Mean share of its distinct neighbours that a linked query found: the lesser mean of those with few and with many. None without any."""
    shares = {False: [], True: []}
    for k, t in truth.items():
        shares[t > FEW_LINKS].append(min(seen.get(k, 0), t) / t)
    return min((sum(x) / len(x) for x in shares.values() if x), default=None)


def _links(nodes: DataFrame, wide: int, least: float, store: Stored) -> tuple[DataFrame, DataFrame, float | None]:
    """Numbers of links (key, n), edges (a, b) that join what is linked, and the audited recall, for vectors of one length."""
    n, label = nodes.count(), str(wide)
    k = max(1, min(MOST_CLUSTERS, -(-2 * n // SHARD_ROWS)))
    sample = hashed_sample(nodes.select("key", "v"), F.col("key"), max(SAMPLE_ROWS, SAMPLE_EACH * k), 23).toArrow().sort_by("key").combine_chunks()
    unit = _unit(_vectors(sample.column("v").combine_chunks())) if sample.num_rows else np.zeros((0, 0))
    c = centroids(unit, k) if len(unit) else unit
    queries, truth, whole = _audit(nodes, n, wide, least, store, label)
    overlap, attempt, exact = OVERLAP, 0, False
    while True:
        name = f"{label}-{attempt}"
        assigned = store.keep(_assign(nodes, c, overlap), f"assigned-{name}")
        blocks = assigned.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / (EXACT_ROWS if exact else SHARD_ROWS)).cast("long").alias("blocks"))
        assigned = assigned.join(F.broadcast(blocks), "cluster").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))  # MOST_CLUSTERS rows at most
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        units = assigned.select("*", F.explode(every).alias("other")).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "v", "mult", "before")
        if exact:
            units = units.withColumn("near", F.array().cast("array<long>"))
        else:
            graph = assigned.groupBy("cluster", "block").applyInArrow(_build, _schema(key=LONG, near=T.ArrayType(LONG)))
            units = units.join(store.keep(graph.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), f"graph-{name}"), "key")
        found = store.keep(units.groupBy("cluster", "i", "j").applyInArrow(_search(least, exact), _schema(key=LONG, other=LONG, n=LONG, d=LONG)), f"found-{name}")
        totals = found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        seen = {r["key"]: r["d"] for r in totals.join(queries.select("key"), "key", "left_semi").select("key", "d").collect()}
        recall = audited_recall(truth, seen)
        if exact or recall is None or recall >= LEAST_RECALL:
            recall = 1.0 if recall is None and (exact or whole) else recall
            return totals.select("key", "n"), found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), recall
        overlap, attempt, exact = 2 * overlap, attempt + 1, 2 * overlap >= len(c)
        if exact:
            c, overlap = c[:1], 1


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Links between vectors with a cosine of least or more, in double precision, and their components.

    Result: id_col, n_links long (other vectors linked directly, copies included), component_id (smallest id reachable
    by links, itself included), kept boolean (it is that smallest id), recall double (audited over vectors of that
    length: the mean share of a linked vector's distinct neighbours that it found, null if the audit met no linked
    vector among the few of all that it drew), a row per input row.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors link with
    those of their own length only. Rows that repeat an id are vectors of their own and share the id. A row with a null
    id takes part in links and counts, but can't name a component; its component is null if it has no other. Other
    columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bound_arrow(spark)
    store = Stored(spark, "embeddings")
    array = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].alias("id"), array.alias("embedding"))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = store.keep(rows.withColumns({"key": F.when(fine, F.xxhash64("embedding")), "check": F.when(fine, F.xxhash64(F.lit(31), "embedding"))}), "rows")
    lengths = [r["n"] for r in rows.where("key is not null").groupBy(F.size("embedding").alias("n")).count().collect()]
    rows, nodes = _keyed(rows, store)
    counts, edges, recalls = None, None, []
    for n in sorted(lengths):
        own, pairs, recall = _links(nodes.where(F.length("v") == 8 * n), n, least, store)
        counts = own if counts is None else counts.unionByName(own)
        edges = pairs if edges is None else edges.unionByName(pairs)
        recalls.append((n, recall))
    if counts is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("recall"))
    joined = components(edges, "a", "b", store, "components").withColumnRenamed("node", "key")
    named = rows.join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = store.keep(named.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id")), "roots")
    out = named.join(least_id, "root", "left").join(nodes.select("key", "mult").join(counts, "key", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "key", "left")
    recall_of = F.create_map(*(x for n, r in recalls for x in (F.lit(n), F.lit(r).cast("double"))))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), F.when(F.col("key").isNull(), F.lit(1.0)).otherwise(recall_of[F.size("embedding")]).alias("recall"))

"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one node. The graph starts from blocks of vectors on the same side of random hyperplanes.
In each round, every node gathers a bounded sample of its neighbours in both directions (at most SAMPLE of
each kind) by Spark joins, and compares those neighbours of neighbours with each other; each node keeps its
K nearest. Which of its edges a node sends next is decided where they are ranked, so a round shuffles edges once.
A query starts at the neighbours of its own node, or at fixed entry nodes, and repeatedly expands
the nearest nodes not yet expanded, until none of its BEAM nearest is left. What queries ask for is sent to the graph
and to the vectors by measured broadcasts, beyond their bound by shuffles. While the graph is built, distances
come from reduced copies: all vectors divided by one factor, so that all rounds rank by the same distances, in
half precision, or in single precision if magnitudes differ by more than WIDE. Distances of queries are double
precision on the original vectors.

Defined cases: rows without id and vectors that are NULL, zero, or hold NULL or non-finite components take
no part, nor do vectors of another length than the commonest; repeated rows (id and vector) count once;
ties go to the smaller id; with fewer candidates all are returned; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.llm.superkmers import Scratch
from chatlens.session import materialise
from chatlens.sizing import broadcast_if_small

K = 32
SAMPLE = 12
TREES = 6
BLOCK = 128
ROUNDS = 8
ENOUGH = 0.01  # rounds end when fewer edges than this share are new
BEAM = 192
EXPAND = 48
ENTRIES = 64
WIDE = 1e4  # between the largest components of two vectors; half precision would lose the smaller one
PER_TASK = 1 << 16  # rows of a task at least, where their number is known; more tasks cost more than they save
_TOP = 1024  # largest component of the reduced copies


def _sized(df, rows):
    """df in no more tasks than its number of rows needs; tables beyond that keep the tasks of their shuffle."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // PER_TASK))


def usable(vectors, like=None):
    """(vec_id, x) of the rows that take part; `like`, rows that do, tell the length instead of the vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    if like is None:
        common = good.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size")
    else:
        common = like.select(F.size("x").alias("size")).limit(1)
    return good.join(F.broadcast(common), F.size(x) == F.col("size")).select("vec_id", x.alias("x"))  # one row


def _nodes(points):
    """Nodes (node, x), and the ids of each that can be among the `best` nearest of a query."""
    return points.groupBy("x").agg(F.min("vec_id").alias("node")).select("node", "x")


def _matrix(column, kind):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 1), kind)


def _reduced(x, largest, kind):
    """Copies of the rows for distances, all divided by the same factor."""
    return pa.array([r.tobytes() for r in (x / largest * _TOP).astype(kind)], pa.binary())


def _assign(bits, largest, kind):
    """Bucket of every vector in each tree, by the signs of random projections; the last tree is random."""
    def run(batches):
        planes = None
        for batch in batches:
            x = _matrix(batch.column("x"), np.float64)
            if planes is None:
                planes = np.random.default_rng(11).standard_normal((x.shape[1], (TREES - 1) * bits)).astype(np.float32)
            unit = (x / np.abs(x).max(1, keepdims=True)).astype(np.float32)  # signs don't depend on the length
            signs = (unit @ planes > 0).reshape(len(x), TREES - 1, bits)
            bucket = (signs * (1 << np.arange(bits))).sum(2)
            mixed = batch.column("random").to_numpy()[:, None] % (1 << bits)
            bucket = np.hstack([bucket, mixed]).ravel()
            row = pa.array(np.repeat(np.arange(len(x)), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES), len(x))), pa.array(bucket), batch.column("node").take(row),
                 _reduced(x, largest, kind).take(row)], ["tree", "bucket", "node", "h"])
    return run


def _copies(largest, kind):
    """The reduced copy of every vector, the same as in `_assign`."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), _reduced(x, largest, kind)], ["node", "h"])
    return run


def _unpacked(members, kind):
    """Vectors of the members; double precision where squares of single precision could vanish."""
    values = members.field("h")
    raw = b"".join(values.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(values), -1).astype(np.float32 if kind == "float16" else np.float64)


def _apart(x):
    """Distances between all rows."""
    norms = (x * x).sum(1)
    return np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * x @ x.T, 0)).astype(np.float32)


def _block_edges(kind):
    """The K nearest in its block of every member."""
    def run(batches):
        for batch in batches:
            column = batch.column("members")
            offsets = column.offsets.to_numpy()
            out = []
            for low, high in zip(offsets[:-1], offsets[1:]):
                members = column.values.slice(low, high - low)
                node = members.field("node").to_numpy()
                if len(node) < 2:
                    continue
                d = _apart(_unpacked(members, kind))
                np.fill_diagonal(d, np.inf)
                near = np.argpartition(d, min(K, len(node) - 1) - 1, axis=1)[:, :K] if len(node) > K else \
                    np.argsort(d, axis=1)[:, :-1]
                out.append((np.repeat(node, near.shape[1]), node[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
            if out:
                u, v, d = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d, pa.float32())], ["u", "v", "d"])
    return run


def _nearest_pairs(u, v, d):
    """The K nearest of each u among different pairs, so that a node in many neighbourhoods doesn't pile up."""
    order = np.lexsort((d, v, u))
    u, v, d = u[order], v[order], d[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, d = u[once], v[once], d[once]
    order = np.lexsort((v, d, u))
    u, v, d = u[order], v[order], d[order]
    starts = np.flatnonzero(np.diff(u, prepend=u[:1] - 1))
    near = np.arange(len(u)) - np.repeat(starts, np.diff(starts, append=len(u))) < K
    return u[near], v[near], d[near]


def _local_join(kind):
    """Compare the gathered neighbours of a node with each other: new ones with all; emit what could improve."""
    def run(batches):
        for batch in batches:
            column = batch.column("members")
            offsets = column.offsets.to_numpy()
            out = []
            for low, high in zip(offsets[:-1], offsets[1:]):
                members = column.values.slice(low, high - low)
                every, sent = members.field("node").to_numpy(), members.field("new").to_numpy(zero_copy_only=False)
                node, at, same = np.unique(every, return_index=True, return_inverse=True)  # both ways: one member
                new = np.bincount(same, sent) > 0
                worst = members.field("worst").to_numpy()[at]
                d = _apart(_unpacked(members, kind)[at])
                fits = (new[:, None] | new[None, :]) & (node[:, None] != node[None, :]) & (d < worst[:, None])
                a, b = np.nonzero(fits)
                out.append((node[a], node[b], d[a, b]))
            u, v, d = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            u, v, d = _nearest_pairs(u, v, d)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d, pa.float32())], ["u", "v", "d"])
    return run


def _best(edges, turn):
    """The K nearest of each node, in one shuffle; an edge that was known is not new. `sent` is the sample of round `turn`."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    near = once.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))).filter(F.col("rank") <= K)
    order = Window.partitionBy("u", "new").orderBy(F.xxhash64("u", "v", F.lit(turn)), "v")
    return near.drop("rank").withColumn("sent", F.row_number().over(order) <= SAMPLE)


def build_graph(nodes):
    """(u, v, d, new): K approximate nearest nodes of each."""
    spark = nodes.sparkSession
    size = F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))
    n, largest, least = nodes.agg(F.count("*"), F.coalesce(F.max(size), F.lit(1.0)), F.coalesce(F.min(size), F.lit(1.0))).first()
    kind = "float16" if largest / WIDE <= least else "float32"
    bits = max(0, math.ceil(math.log2(max(n, 2) / BLOCK)))
    assigned = nodes.withColumn("random", F.abs(F.xxhash64("node"))).mapInArrow(
        _assign(bits, largest, kind), "tree long, bucket long, node long, h binary")
    sizes = assigned.groupBy("tree", "bucket").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
    split = assigned.join(sizes, ["tree", "bucket"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "tree"), "parts"))  # any split will do for a start
    blocks = split.groupBy("tree", "bucket", "part").agg(F.collect_list(F.struct("node", "h")).alias("members"))
    first = _sized(blocks.select("members"), TREES * n).mapInArrow(_block_edges(kind), "u long, v long, d float")
    scratch = Scratch(spark)
    copies = scratch.write(nodes.mapInArrow(_copies(largest, kind), "node long, h binary"), "copies")
    edges = scratch.write(_sized(_best(first.withColumn("new", F.lit(True)), 0), K * n), "graph0")
    for turn in range(ROUNDS):
        order = Window.partitionBy("at", "new").orderBy(F.xxhash64("at", "node", F.lit(turn)), "node")
        back = edges.select(F.col("v").alias("at"), F.col("u").alias("node"), "new").withColumn(
            "rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE).drop("rank")
        sample = edges.filter("sent").select(F.col("u").alias("at"), F.col("v").alias("node"), "new").unionByName(back)
        worst = edges.groupBy(F.col("u").alias("node")).agg(
            F.when(F.count("*") < K, float("inf")).otherwise(F.max("d")).cast("float").alias("worst"))
        known = copies.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf")).cast("float")))
        gathered = sample.join(known, "node").groupBy("at").agg(
            F.collect_list(F.struct("node", "new", "worst", "h")).alias("members"))  # 4 * SAMPLE at most
        found = _sized(gathered.select("members"), 4 * SAMPLE * n).mapInArrow(_local_join(kind), "u long, v long, d float")
        kept = edges.select("u", "v", "d", (F.col("new") & ~F.col("sent")).alias("new"))
        ranked = _best(kept.unionByName(found.withColumn("new", F.lit(True))), turn + 1)
        edges = scratch.write(_sized(ranked, K * n), f"graph{turn + 1}")
        scratch.drop(f"graph{turn}")
        if edges.filter("new").count() <= ENOUGH * K * n:
            break
    scratch.drop("copies")
    return edges.select("u", "v", "d", "new")


def _distances(batches):
    for batch in batches:
        a, b = _matrix(batch.column("x"), np.float64), _matrix(batch.column("qx"), np.float64)
        d = np.sqrt(((a - b) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("node"), pa.array(d)], ["q", "node", "d"])


def _measured(pairs, nodes, queries):
    """Exact distances of (q, node) pairs, which are sent to the vectors if they fit a broadcast."""
    return nodes.join(broadcast_if_small(pairs), "node").join(queries.select("q", F.col("x").alias("qx")), "q").select(
        "q", "node", "x", "qx").mapInArrow(_distances, "q long, node long, d double")


def _ranked(state, beam):
    """The nodes nearest to each query; `now` marks those to expand next. One shuffle, by query."""
    near = state.repartition("q").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "node")))
    order = Window.partitionBy("q", "open").orderBy("d", "node")
    return near.filter(F.col("rank") <= beam).drop("rank").withColumn(
        "now", F.col("open") & (F.row_number().over(order) <= EXPAND))


def search(nodes, edges, queries, beam=BEAM):
    """(q, node, d): the nodes nearest to each query (q, x) that a greedy search of the graph reaches."""
    spark = nodes.sparkSession
    queries = broadcast_if_small(queries)
    links = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    links = materialise(_sized(links, 2 * edges.count()), "links")
    most = beam * queries.count()
    own = queries.select("q").join(nodes.select(F.col("node").alias("q")), "q", "left_semi")
    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    strangers = queries.select("q").join(own, "q", "left_anti").crossJoin(F.broadcast(entries))  # ENTRIES rows
    start = own.select("q", F.col("q").alias("node")).unionByName(strangers)
    scratch, turn = Scratch(spark), 0
    state = scratch.write(_sized(_ranked(_measured(start, nodes, queries).withColumn("open", F.lit(True)), beam), most), "beam0")
    while not state.filter("now").isEmpty():
        chosen = broadcast_if_small(state.filter("now").select("q", F.col("node").alias("u")))
        reached = links.join(chosen, "u").select("q", F.col("v").alias("node"), F.lit(False).alias("seen"))
        pairs = reached.unionByName(state.select("q", "node", F.lit(True).alias("seen")))
        fresh = pairs.groupBy("q", "node").agg(F.max("seen").alias("seen")).filter("NOT seen").drop("seen")
        after = state.select("q", "node", "d", (F.col("open") & ~F.col("now")).alias("open")).unionByName(
            _measured(_sized(fresh, EXPAND * most), nodes, queries).withColumn("open", F.lit(True)))
        state = scratch.write(_sized(_ranked(after, beam), most), f"beam{turn + 1}")
        scratch.drop(f"beam{turn}")
        turn += 1
    return state.select("q", "node", "d")


def nearest(vectors, queries, best=10):
    """query_id, rank, vec_id and score of the `best` nearest rows of each query (query_id, embedding)."""
    rows = vectors.count()
    points = materialise(_sized(usable(vectors).distinct(), rows), "points")
    nodes = materialise(_sized(_nodes(points), rows), "nodes")
    edges = build_graph(nodes)
    asked = usable(queries.select(F.col("query_id").alias("vec_id"), "embedding"), points).select(
        F.col("vec_id").alias("query_id"), "x")
    placed = asked.join(nodes, "x", "left")
    distinct = placed.groupBy("x").agg(F.coalesce(F.first("node"), -1 - F.min("query_id")).alias("q"))
    placed = materialise(_sized(asked.join(distinct, "x").select("query_id", "q", "x"), rows), "asked")
    found = search(nodes, edges, placed.select("q", "x").distinct())
    few = Window.partitionBy("q").orderBy("d", "node")
    found = found.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= best + 1).drop("place")
    order = Window.partitionBy("x").orderBy("vec_id")
    members = points.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= best + 1).join(
        nodes, "x").select("node", "vec_id")
    rows = placed.select("query_id", "q").join(found, "q").join(members, "node").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= best).select(
        "query_id", "rank", "vec_id", F.col("d").alias("score"))

"""Exact top-k search by integer inner product over vectors in order of length.

Every component x becomes floor(1024 x), taken as double. Candidates are sorted by length (Euclidean norm),
longest first, and dealt in that order to parts of at most PART_BYTES; queries to slices of at most SLICE_BYTES. The
longest HEAD candidates give each query a first k-th best score. Then each part meets each slice of queries it can
still serve (its greatest length times the query's reaches that score), and passes it block by block:

- A candidate is dropped where its length times the query's is below the query's k-th best score so far.
- The rest are compared in a rotated space, the right singular vectors of all vectors, strongest first: a
  product over the first components, plus the product of the lengths of what is left out (Cauchy and Schwarz),
  bounds the score; with each stage more components are summed and fewer pairs remain.
- What remains is scored exactly: in double precision where all sums are integers below 2**53, else in Python's.

Bounds have a margin for rounding, so nothing is lost. A part and a slice meet as a cogroup of bounded size, and
all that leaves it are its own best k for each query above the first score.

Defined cases: rows without id, vectors that are NULL or hold components that are NULL or not finite (also after
scaling) take no part. A vector meets those with as many components only. Repeated rows (equal id and scaled vector)
count once; rows of one id with other vectors are queries and candidates of their own. Ties go to the smaller id. With
fewer candidates than k all are returned; zero vectors take part. Scores beyond 64 bits are ranked exactly and shown
as the nearest number that fits. Other columns are ignored; an empty table gives no rows.
"""

import math
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.session import materialise
from chatlens.sizing import broadcast_if_small

K = 10
SCALE = 1024.0
HEAD = 4096
PART_BYTES = 64 << 20
SLICE_BYTES = 16 << 20
BLOCK = 2048
QUERIES = 512
STAGES = (0.25, 0.5)  # shares of the components that are summed before what is left is scored
MARGIN = 1e-9
EXACT = float(1 << 53)
_WIDE = 1e250
_PAIRS = 1 << 15
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_COMPLEMENT = str.maketrans("0123456789", "9876543210")
_FOUND = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
                    ("digits", pa.int32()), ("spelled", pa.string())])
_FOUND_DDL = "query_id long, query_row long, vec_id long, score long, digits int, spelled string"


def scaled(vectors, column="embedding"):
    """(vec_id, row, size, x, norm) of the rows that take part; row tells rows of the same id apart."""
    x = F.transform(column, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    # floor gives a long; components beyond it are whole numbers as they are
    wide = F.transform(column, lambda v: v.cast("double") * SCALE)
    whole = F.zip_with(x, wide, lambda a, b: F.when(F.abs(b) < 2.0 ** 52, a).otherwise(b))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size(column).alias("size"), whole.alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v))
    return rows.distinct().withColumns({"norm": norm, "row": F.xxhash64("x")})


def _matrix(column, size):
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def _products(size):
    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            norm = batch.column("norm").to_numpy()
            fine = (norm > 0) & np.isfinite(norm)
            unit = x[fine] / norm[fine, None]
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % 8], pa.int32()), pa.array([total.tobytes()])], ["part", "total"])
    return run


def _sum_products(table):
    total = sum(np.frombuffer(x.as_py()) for x in table.column("total"))
    return pa.table({"total": pa.array([total.tobytes()], pa.binary())})


def rotation(rows):
    """The commonest size, and the right singular vectors of all vectors of that size, strongest first.

    Each task sums the products of its vectors, as unit vectors; the driver gets at most eight sums, of size
    times size numbers each.
    """
    common = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if common is None or not common["size"]:
        return 0, np.zeros((0, 0))
    size = common["size"]
    sums = rows.where(F.col("size") == size).select("x", "norm").mapInArrow(_products(size), "part int, total binary")
    parts = sums.groupBy("part").applyInArrow(_sum_products, "total binary").collect()
    total = sum(np.frombuffer(r["total"]) for r in parts).reshape(size, size)
    return size, np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def _reached(score):
    """Scores as bounds from below."""
    if score.dtype != object:
        return score.astype(np.float64)
    return np.array([float(v) if abs(v) < _WIDE else _WIDE if v > 0 else -math.inf for v in score], np.float64)


class _Best:
    """The best k rows so far of each query, as parallel arrays, and the score that others have to reach."""

    def __init__(self, first, k):
        self.k, self.reach = k, first.copy()
        self.query, self.vector, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query, vector, score):
        query, vector, score = _largest(
            *(np.concatenate(x) for x in ((self.query, query), (self.vector, vector), (self.score, score))), self.k)
        self.query, self.vector, self.score = query, vector, score
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        self.reach[query[last]] = np.maximum(self.reach[query[last]], _reached(score[last]))


def _largest(query, vector, score, k):
    """The best k rows of each query; ties by the smaller id."""
    if score.dtype == object:
        order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], vector[i])), np.int64)
    else:
        order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], vector[kept], score[kept]


def _exact(x, y, row, column):
    """Inner products of rows of x with rows of y; all numbers are whole."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(x.shape[1], 1) < EXACT:
        if 4 * len(row) > len(x) * len(y):
            return (x @ y.T)[row, column].astype(np.int64)
        parts = [slice(low, low + _PAIRS) for low in range(0, len(row), _PAIRS)]
        return np.concatenate([np.einsum("ij,ij->i", x[row[p]], y[column[p]]) for p in parts]).astype(np.int64)
    left, right = ([[int(v) for v in r] for r in m.tolist()] for m in (x, y))
    return np.array([sum(map(operator.mul, left[i], right[j])) for i, j in zip(row, column)] + [None], object)[:-1]


def _open_pairs(x, y, allowed, reach, k):
    """Those of the allowed pairs of a query and a candidate that bounds leave open; x and y: norms, rotated vectors,
    and the lengths of what is left out after each stage."""
    limit = np.outer(x["norm"], y["norm"])
    if not limit.max() < _WIDE:
        return allowed  # sums of such vectors can overflow
    margin = MARGIN * limit + MARGIN
    slack = reach[:, None] - margin
    left = allowed & ~(limit < slack)
    total = np.zeros_like(limit)
    for (a, b), x_rest, y_rest in zip(x["steps"], x["rest"], y["rest"]):
        if not left.any():
            return left
        total += x["turned"][:, a:b] @ y["turned"][:, a:b].T
        left &= ~(total + np.outer(x_rest, y_rest) < slack)
    if left.shape[1] > k:  # now the score but for rounding: what k others of the block beat is out
        floor = np.partition(np.where(left, total, -np.inf), left.shape[1] - k, axis=1)[:, -k]
        left &= ~(total < (floor - 2 * margin.max(1))[:, None])
    return left


def _prepared(x, norm, turn, stages):
    """Steps of the sums, rotated vectors, and lengths of what each step leaves out."""
    size = x.shape[1]
    ends = sorted({min(max(1, int(size * s)), size) for s in stages} | {size}) if size else [0]
    turned = x @ turn if turn is not None else x
    rest = [np.sqrt((turned[:, e:] ** 2).sum(1)) for e in ends]
    return {"norm": norm, "turned": turned, "rest": rest, "steps": list(zip([0, *ends], ends))}


def _part(prepared, rows):
    return prepared | {"norm": prepared["norm"][rows], "turned": prepared["turned"][rows],
                       "rest": [r[rows] for r in prepared["rest"]]}


def _search(queries, candidates, first, turn, k, stages):
    """Best rows of the queries (id, row, x, norm) among the candidates, which come longest first."""
    (ids, marks, x, norm), (others, other_marks, y, length) = queries, candidates
    best = _Best(first, k)
    left, right = _prepared(x, norm, turn, stages), _prepared(y, length, turn, stages)
    for low in range(0, len(others), BLOCK):
        block = slice(low, low + BLOCK)
        for start in range(0, len(ids), QUERIES):
            part = slice(start, start + QUERIES)
            others_only = (ids[part, None] != others[None, block]) | (marks[part, None] != other_marks[None, block])
            pairs = _open_pairs(_part(left, part), _part(right, block), others_only, best.reach[part], k)
            row, column = np.nonzero(pairs)
            if len(row):
                score = _exact(x[part], y[block], row, column)
                best.add(*_largest(row + start, others[block][column], score, k))
    return best


def _met(size, turn, k, stages):
    def run(_, queries, candidates):
        out = {c: [] for c in ("query_id", "query_row", "vec_id", "score", "digits", "spelled")}
        for n in sorted(set(pc.unique(queries.column("size")).to_pylist()) & set(pc.unique(candidates.column("size")).to_pylist())):
            q, c = (t.filter(pc.equal(t.column("size"), n)).combine_chunks() for t in (queries, candidates))
            c = c.sort_by([("norm", "descending"), ("vec_id", "ascending")])
            sides = [(t.column("vec_id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("x").combine_chunks(), n),
                      t.column("norm").to_numpy()) for t in (q, c)]
            first = q.column("first").fill_null(-math.inf).to_numpy().astype(np.float64)
            with np.errstate(all="ignore"):
                best = _search(*sides, first, turn if n == size else None, k, stages)
            out["query_id"] += sides[0][0][best.query].tolist()
            out["query_row"] += sides[0][1][best.query].tolist()
            out["vec_id"] += best.vector.tolist()
            for s in map(int, best.score):
                fits = _LEAST < s < _MOST
                digits = str(abs(s))
                out["score"].append(min(max(s, _LEAST), _MOST))
                out["digits"].append(0 if fits else len(digits) if s > 0 else -len(digits))
                out["spelled"].append(None if fits else digits if s > 0 else digits.translate(_COMPLEMENT))
        return pa.table(out, _FOUND)
    return run


def _ranked(found, k):
    """The k best of each query row. Scores beyond 64 bits go by number of digits, then by digits."""
    best = Window.partitionBy("query_id", "query_row").orderBy(
        F.desc("score"), F.desc("digits"), F.desc_nulls_last("spelled"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_inner_products(vectors, queries, k=K, head=HEAD, part_bytes=PART_BYTES, slice_bytes=SLICE_BYTES, stages=STAGES):
    """query_id, rank, vec_id and score of the k greatest inner products of each query row (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = materialise(scaled(vectors), "vectors")
    asked = materialise(scaled(queries), "queries")
    size, turn = rotation(rows)
    turn = turn if size else None
    weight = F.sum(F.lit(64) + 8 * F.col("size"))
    n_parts = max(math.ceil((rows.agg(weight).first()[0] or 0) / part_bytes), spark.sparkContext.defaultParallelism)
    n_slices = max(math.ceil((asked.agg(weight).first()[0] or 0) / slice_bytes), 1)
    # in order of length; equal lengths are dealt by id
    parts = materialise(
        rows.repartitionByRange(n_parts, F.desc("norm"), "vec_id").withColumn("part", F.spark_partition_id()), "parts")
    bounds = parts.groupBy("part", "size").agg(F.max("norm").alias("longest"))  # one row for each part and size
    slices = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_slices)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_slices - 1).cast("long")))

    longest = materialise(rows.orderBy(F.desc("norm"), "vec_id").limit(head), "head").withColumn("slice", every)
    met = _met(size, turn, k, stages)

    def meet(key, queries, candidates):
        return met(key, queries, candidates)

    seen = slices.withColumn("first", F.lit(None).cast("double")).groupBy("slice").cogroup(longest.groupBy("slice"))
    first = _ranked(seen.applyInArrow(meet, _FOUND_DDL), k).where((F.col("rank") == k) & (F.col("score") > _LEAST)).select(
        F.col("query_id").alias("vec_id"), F.col("query_row").alias("row"), F.col("score").cast("double").alias("first"))
    started = materialise(slices.join(first, ["vec_id", "row"], "left"), "started")

    # the parts that can serve a query: there its slice goes
    reached = started.join(broadcast_if_small(bounds), "size").where(
        F.col("first").isNull() | (F.col("norm") * F.col("longest") * (1 + MARGIN) + MARGIN >= F.col("first"))
    ).drop("longest")
    wanted = broadcast_if_small(reached.select("part", "slice").distinct())  # a pair of numbers for each meeting
    cells = reached.groupBy("part", "slice").cogroup(parts.join(wanted, "part").groupBy("part", "slice"))
    return _ranked(cells.applyInArrow(meet, _FOUND_DDL), k).select("query_id", "rank", "vec_id", "score")

"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles (64-bit hashes). Documents with the same set are one
class. The tokens of a class are ordered by estimated frequency, rare ones first, from a count sketch of
fixed size over all documents. A set of s tokens that must share a = ceil(0.8 s) with a partner keeps a
prefix of s - a + L tokens; two linked sets share at least min(L, L') tokens of their prefixes. Each class
chooses the L with the least estimated cost: postings read, plus verifications, which fall as L grows. A
shared token only counts if its place in both prefixes suits the overlap that the two sizes ask for.

Postings aren't paired within a token. First every class is verified against one leader, the class of its
tokens that shares most; what that links is one component. Classes left outside a token's main component are
verified against other leaders of it, a few times. Then only classes of different components that share
tokens are paired: each class outside a token's main component with the others. Within a component no
further link can change the result. All verified links are exact Jaccard comparisons of whole sets.

A near copy shares its rarest tokens with many that it isn't linked to. So that such a group doesn't send a row for
every two of its members on to the counting of shared tokens, pairs across components are first held against
bitmaps of their sets (SIGNATURE_BITS hashed bits each): a bit that only one side has stands for a token that only that
side has, and two linked sets differ by few. No linked pair fails; the larger the sets, the fewer others do (bitmaps of
sets well beyond SIGNATURE_BITS tokens are full). The two sides of a token are still compared inside the join.

Defined cases: NULL or empty texts and texts without words have 0 shingles and are their own component;
rows with repeated ids are documents of their own; a component without any id has a NULL component_id;
other columns are ignored.
"""

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.llm.components import connected_components, extended_components
from chatlens.llm.workers import thrifty
from chatlens.session import materialise, release, small_batches
from chatlens.sizing import broadcast_if_small

WORDS = 5
PERCENT = 80
MOST_MATCHES = 8
VERIFY_COST = 20.0
RETRIES = 2
SIGNATURE_BITS = 512
SKETCH_BITS = 20
SLICE_BYTES = 1 << 19
ARROW_ROWS = 1000
_SKETCH_BLOCKS = 64
_CELLS = np.uint64((1 << SKETCH_BITS) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD1B54A32D192ED03)


def shingle_sets(data, offsets, k=WORDS):
    """The sorted distinct shingle hashes of each text."""
    data = flat.LOWER[data]
    starts, ends, bounds = flat.words(data, offsets)
    word = flat.word_hashes(data, starts, ends)
    grams = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for i in range(k):
        grams = grams * _STEP + word[i:i + len(grams)]
    grams = flat.mix(grams)
    sets = []
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low >= k:
            sets.append(np.unique(grams[low:high - k + 1]))
        elif high > low:
            short = np.full(1, high - low, np.uint64)
            for w in word[low:high]:
                short = flat.mix(short * _STEP + w)
            sets.append(short)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _digest(tokens):
    """Two order-free 64-bit sums that name a set."""
    return np.array([flat.mix(tokens).sum(), flat.mix(tokens * _OTHER).sum()], np.uint64).astype(np.int64)


@thrifty
def _summaries(batches):
    """n and digest of every document; after them the sketch counts of this task, in blocks."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text"), SLICE_BYTES):
            sets = shingle_sets(data, offsets)
            np.add.at(sketch, (np.concatenate(sets) & _CELLS).astype(np.int64), 1)
            digests = np.array([_digest(s) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, n), batch.column("key").slice(first, n),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc_id", "key", "n", "d1", "d2", "block", "counts"],
            )
    if sketch.any():
        nothing = [pa.nulls(_SKETCH_BLOCKS, t) for t in (batch.column("doc_id").type, *[pa.int64()] * 4)]
        blocks = [row.tobytes() for row in sketch.reshape(_SKETCH_BLOCKS, -1)]
        yield pa.RecordBatch.from_arrays(
            [*nothing, pa.array(range(_SKETCH_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())],
            ["doc_id", "key", "n", "d1", "d2", "block", "counts"],
        )


def _sum_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counts of one block; they are added batch by batch."""
    total = 0
    for batch in batches:
        for raw in batch.column("counts"):
            total = total + np.frombuffer(raw.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                     ["block", "counts"])


def _sketch(summaries):
    """Counts by hash cell over all documents: 2**SKETCH_BITS numbers, whatever the corpus."""
    blocks = summaries.filter("block IS NOT NULL").select("block", "counts")
    found = blocks.groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect()
    sketch = np.zeros((_SKETCH_BLOCKS, (1 << SKETCH_BITS) // _SKETCH_BLOCKS), np.int64)
    for row in found:
        sketch[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return sketch.reshape(-1)


def required(n):
    """Fewest tokens that a set of n shares with a partner."""
    return (PERCENT * n + 99) // 100


def prefix_of(tokens, frequency):
    """Prefix of a sorted set, and the matches it asks for."""
    often = frequency[(tokens & _CELLS).astype(np.int64)]
    order = np.argsort(often, kind="stable")  # ties by hash
    n = len(tokens)
    need = required(n)
    matches = np.arange(1, min(MOST_MATCHES, need) + 1)
    sizes = n - need + matches
    cost = np.cumsum(often[order])[sizes - 1] * (1 + VERIFY_COST / matches)
    best = int(np.argmin(cost))
    return tokens[order[:sizes[best]]], int(matches[best])


def signature(tokens):
    """Bitmap of a set, as 64-bit words."""
    bits = np.zeros(SIGNATURE_BITS, bool)
    bits[(flat.mix(tokens * _OTHER) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _prefixes(sketch):
    @thrifty
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, n)
                sets = shingle_sets(data, offsets)
                wanted = np.column_stack([part.column("d1").to_numpy(), part.column("d2").to_numpy()])
                good = [i for i in range(n) if (_digest(sets[i]) == wanted[i]).all()]  # an id may repeat
                found = [prefix_of(sets[i], sketch.value) for i in good]
                tokens = np.concatenate([t for t, _ in found]) if found else np.zeros(0, np.uint64)
                cuts = np.cumsum([0] + [len(t) for t, _ in found])
                bitmaps = np.array([signature(sets[i]) for i in good], np.int64).ravel()
                words = SIGNATURE_BITS // 64
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(good, pa.int64())),
                     pa.array([len(sets[i]) for i in good], pa.int32()), pa.array([m for _, m in found], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tokens.astype(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * words, pa.int32()), pa.array(bitmaps))],
                    ["node", "n", "matches", "tokens", "bitmap"],
                )
    return run


@thrifty
def _named(batches):
    """Texts that have the set of their class; others only share the id."""
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text"), SLICE_BYTES):
            part = batch.slice(first, n)
            wanted = np.column_stack([part.column("d1").to_numpy(), part.column("d2").to_numpy()])
            good = [i for i, s in enumerate(shingle_sets(data, offsets)) if (_digest(s) == wanted[i]).all()]
            yield part.select(["node", "text"]).take(pa.array(good, pa.int64()))


@thrifty
def _verified(batches):
    """Pairs of texts whose sets are similar enough."""
    for batch in batches:
        sides = []
        for node, text in (("a", "text_a"), ("b", "text_b")):
            ids, first, inverse = np.unique(batch.column(node).to_numpy(), return_index=True, return_inverse=True)
            chosen = batch.column(text).take(pa.array(first))
            sets = [s for _, _, data, offsets in flat.slices(chosen, SLICE_BYTES) for s in shingle_sets(data, offsets)]
            sides.append((sets, inverse))
        (left, at), (right, bt) = sides
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = left[at[i]], right[bt[i]]
            shared = len(x) + len(y) - len(np.union1d(x, y))
            linked[i] = 100 * shared >= PERCENT * (len(x) + len(y) - shared)
        kept = batch.filter(pa.array(linked))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])


def _written(df, name):
    """A copy as `materialise` makes it. Tasks hold few texts at once, and what finished queries left on the executors
    and in the driver (broadcasts, shuffle files, plans) goes."""
    spark = df.sparkSession
    with small_batches(spark, ARROW_ROWS):
        copy = materialise(df, name)
    release(spark)
    return copy


class _Join:
    """The tables one join works on, all in the shared folder."""

    def __init__(self, documents):
        spark = documents.sparkSession
        self.documents = documents.select("doc_id", "text")
        id_type = documents.schema["doc_id"].dataType.simpleString()
        keyed = self.documents.withColumn("key", F.xxhash64("doc_id", "text"))
        everything = _written(keyed.mapInArrow(
            _summaries, f"doc_id {id_type}, key long, n long, d1 long, d2 long, block int, counts binary"), "shingles")
        self.summaries = everything.filter("block IS NULL").select("doc_id", "key", "n", "d1", "d2")
        self.sketch = spark.sparkContext.broadcast(_sketch(everything))
        classes = self.summaries.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
        self.classes = _written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        prefixes = _written(self.texts(self.classes).mapInArrow(
            _prefixes(self.sketch), "node long, n int, matches int, tokens array<long>, bitmap array<long>"), "prefixes")
        words = [F.col("bitmap")[i].alias(f"w{i}") for i in range(SIGNATURE_BITS // 64)]
        self.bitmaps = prefixes.select("node", F.struct(*words).alias("bits"))
        postings = prefixes.select("node", "n", "matches", F.posexplode("tokens").alias("pos", "t"))
        several = postings.groupBy("t").count().filter("count > 1").select("t")
        self.postings = _written(postings.join(several, "t"), "postings")

    def texts(self, classes):
        """(node, d1, d2, text) of classes, by one document of each."""
        named = broadcast_if_small(classes.select("node", "d1", "d2", F.col("rep").alias("doc_id")))
        return self.documents.join(named, self.documents["doc_id"].eqNullSafe(named["doc_id"])).select(
            "node", "d1", "d2", "text")

    def verify(self, pairs):
        """Links (u, v) among the pairs, by comparing whole sets."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        needed = self.classes.join(nodes, "node", "left_semi")
        texts = self.texts(needed).mapInArrow(_named, "node long, text string")
        texts = _written(texts, "texts")
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_verified, "u long, v long")


def _could_link(x, y):
    """Whether a shared token lies in the prefixes that a linked pair of these sizes must have it in."""
    need = F.floor((PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 99 + PERCENT) / (100 + PERCENT))
    matches = F.least(f"{x}.matches", f"{y}.matches")
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= PERCENT * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (F.col(f"{x}.pos") < F.col(f"{x}.n") - need + matches) & (
        F.col(f"{y}.pos") < F.col(f"{y}.n") - need + matches)


def _enough(tokens):
    """Pairs (a, b) with enough shared prefix tokens, and how many."""
    return tokens.groupBy("a", "b", "matches").agg(F.count("*").alias("shared")).filter("shared >= matches")


def _star(postings):
    """Each class with its best leader. The leader of a token is the class with the most shared prefix tokens."""
    central = postings.groupBy("node").agg(F.count("*").alias("central"))
    entry = F.struct("node", "n", "matches", "pos")
    first = postings.join(central, "node").groupBy("t").agg(
        F.max_by(entry, F.struct("central", -F.col("node"))).alias("y"))
    both = postings.select("t", entry.alias("x")).join(first, "t").filter(
        (F.col("x.node") != F.col("y.node")) & _could_link("x", "y"))
    pairs = _enough(both.select(
        F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.least("x.matches", "y.matches").alias("matches")))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")


def _mixed(postings, roots):
    """Postings (t, y, root, main) of the tokens that several components share; main has most of a token's classes."""
    placed = _written(postings.join(roots, "node", "left").select(
        "t", F.struct("node", "n", "matches", "pos").alias("y"), F.coalesce("root", "node").alias("root")), "placed")
    groups = placed.groupBy("t", "root").count().groupBy("t").agg(
        F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    return placed.join(groups.select("t", "main"), "t")


def _again(mixed, turn):
    """Each class outside the main component with its best leader of that, one class a token, other ones each turn."""
    leader = mixed.filter("root = main").groupBy("t").agg(
        F.max_by("y", F.struct(F.xxhash64("y.node", F.lit(turn)), "y.node")).alias("y"))
    outside = mixed.filter("root <> main").select("t", F.col("y").alias("x"))
    both = outside.join(leader, "t").filter(_could_link("x", "y"))
    pairs = _enough(both.select(
        F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.least("x.matches", "y.matches").alias("matches")))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")


def _bitmaps_allow(x, y):
    """Whether neither side has more tokens of its own, by the bitmaps, than a linked pair of these sizes."""
    need = F.floor((PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 99 + PERCENT) / (100 + PERCENT))

    def own(a, b):
        words = [F.col(f"{a}_bits.w{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}_bits.w{i}"))) for i in range(SIGNATURE_BITS // 64)]
        return reduce(add, map(F.bit_count, words))

    return (own(x, y) <= F.col(f"{x}.n") - need) & (own(y, x) <= F.col(f"{y}.n") - need)


def _shared_across(mixed, bitmaps):
    """Shared tokens of classes of different components: of those outside a token's main component with all others."""
    bitmaps = broadcast_if_small(bitmaps)
    placed = mixed.join(bitmaps, mixed["y.node"] == bitmaps["node"]).select("t", "main", "root", "y", F.col("bits").alias("y_bits"))
    outside = placed.filter("root <> main").select(
        "t", F.col("y").alias("x"), F.col("y_bits").alias("x_bits"), F.col("root").alias("x_root"))
    once = (F.col("root") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
    return outside.join(placed, "t").filter(
        (F.col("root") != F.col("x_root")) & once & _could_link("x", "y") & _bitmaps_allow("x", "y"))


def _across(mixed, bitmaps):
    """Classes of different components that share enough tokens."""
    return _enough(_shared_across(mixed, bitmaps).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
        F.least("x.matches", "y.matches").alias("matches"))).select("a", "b")


def _ordered(pairs):
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _placed(documents):
    """doc_id, key (hash of id and text), n, root and component_id of every document; root is NULL without shingles."""
    join = _Join(documents)
    tried = _written(_ordered(_star(join.postings)).distinct(), "pairs")
    roots = connected_components(_written(join.verify(tried), "links"))
    for turn in range(RETRIES):  # only spares pairs: what is still apart then is compared in full
        pairs = _ordered(_again(_mixed(join.postings, roots), turn)).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = _written(pairs, "pairs")
        tried = tried.unionByName(pairs)
        roots = extended_components(roots, _written(join.verify(pairs), "links"))
    rest = _across(_mixed(join.postings, roots), join.bitmaps).join(tried, ["a", "b"], "left_anti")
    more = _written(join.verify(_written(rest, "pairs")), "links")
    roots = extended_components(roots, more)
    placed = join.classes.join(roots, "node", "left").select(
        "d1", "d2", "n", "rep", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "root").select("d1", "d2", "n", "root", "component_id")
    rows = join.summaries.filter("n > 0").join(named, ["d1", "d2", "n"])
    alone = join.summaries.filter("n = 0").withColumns(
        {"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return rows.unionByName(alone).drop("d1", "d2")


def components(documents):
    """doc_id, n_shingles and component_id of every document."""
    return _placed(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(documents):
    """The documents without all but one of each component (the smallest id), all columns unchanged.

    Of rows that are equal in id and text one stays. Documents without shingles all stay.
    """
    placed = _written(_placed(documents).filter("root IS NOT NULL").select("doc_id", "key", "root"), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("best")).select(
        "root", F.col("best.key").alias("best"))
    marked = placed.join(first, "root").groupBy("doc_id", "key").agg(
        F.max(F.col("key") != F.col("best")).alias("drop"), F.count("*").alias("rows"))
    marked = broadcast_if_small(marked.filter("drop OR rows > 1").select(
        F.col("key").alias("marked_key"), F.col("doc_id").alias("marked_id"), "drop"))

    def joined(marks, how):
        same = (F.xxhash64(documents["doc_id"], documents["text"]) == marks["marked_key"]) & documents[
            "doc_id"].eqNullSafe(marks["marked_id"])
        return documents.join(marks, same, how)

    repeated = joined(marked.filter("NOT drop"), "left_semi")
    return joined(marked, "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "text"]))

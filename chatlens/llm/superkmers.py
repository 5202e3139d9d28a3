"""Repeated windows by super-k-mers: the part that word and byte windows have in common.

A window is `k` consecutive symbols (words or bytes) of one document. Its minimiser is a run of `m` symbols
in it: the run of `t` symbols with the least hash (the leftmost of equal ones) starts at some place of the
window, and the minimiser starts at that place modulo k - m + 1 (a mod-minimiser; the plain one if t is m).
So equal windows have equal minimisers. Consecutive windows with the same minimiser are one super-k-mer.

Of equal texts one is searched, the one with the smallest id; it stands for all of them, and what is removed
from its copies is known without a search.

1. Minimisers that occur once can't belong to a repeated window. The others are found by one shuffle of
   (minimiser, document key); repeats within a slice are known before it and don't meet in one task.
2. Super-k-mers with a repeated minimiser are listed, without text, in two halves: windows in which the
   minimiser lies left and those in which it lies right. All windows of a half share more symbols than the
   minimiser, its core; a half is named by the hash of its core and a digest of its content.
3. Equal halves are one class with a count and the smallest document id. A core with a single class needs
   no text: all its windows have that count. So minimisers that meet by chance, whose number grows faster
   than the input, end here.
4. For the others one string of each class goes to the bucket of its core, where a solver compares the
   windows exactly. Cores with more than HOT classes (a passage between thousands of different neighbours)
   aren't gathered: their windows are counted by 128-bit digests.
5. The marked windows go back to the documents of each class, and from there to the texts.

The texts move once, into a table in buckets of their names; later only lists move to them. There are as many buckets
as the texts need, whatever the number of shuffle partitions; lists too long for a hash table of a bucket are sorted.

Documents are named by a hash of id and text: rows that are equal in both have equal results. If such rows
are the first of their text, all of them are searched, which changes no result: their windows occur in copies.
Intermediates are removed as soon as what was made of them is written.
"""

import dataclasses
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.session import materialise, release, remove, scratch_path
from chatlens.sizing import broadcast_if_small, copy_with_width, total_width

HOT = 1000
BUCKET_BYTES = 1 << 24
LISTED_BYTES = 1 << 24  # lists for a broadcast: the table of texts stays where it is also without one
HASHED_BYTES = 1 << 23  # lists of a bucket, as measured: hash tables cannot spill
LARGEST = np.iinfo(np.int64).max
_SLICE = 1 << 20
_BLOCK = 1 << 17  # symbols hashed at once: their arrays stay in a core's cache
_CHUNK = 1 << 18
_INDEX_BITS = np.uint64(28)
_GRAMS, _CONTENT, _SECOND = 2, 3, 4


@dataclasses.dataclass(frozen=True)
class Windows:
    """What to look for: windows of k symbols by minimisers of m, chosen by runs of t; parse gives symbols and bounds
    of a slice."""

    k: int
    m: int
    t: int
    parse: Callable
    pack: Callable
    solve: Callable
    once_a_document: bool


def super_kmers(symbols, bounds, k, m, t, halves=False, keep=None, keep_cores=None):
    """Document, first symbol, number of windows and minimiser hash of every super-k-mer.

    With halves also the hash of the core and the content digest, of every half; keep tells by documents and minimisers
    which halves are wanted, keep_cores by documents and cores.
    """
    windows = max(len(symbols) - k + 1, 0)
    room = np.maximum(np.diff(bounds) - k + 1, 0)
    begins, stops = bounds[:-1][room > 0], (bounds[:-1] + room)[room > 0]
    if not len(begins):
        nothing = np.zeros(0, np.int64)
        return (nothing,) * (6 if halves else 4)
    grams = flat.rolling(_GRAMS)
    sums = grams.prefix(symbols)
    at = np.arange(len(symbols) - t + 1)
    low = (np.uint64(1) << _INDEX_BITS) - np.uint64(1)
    hashes = grams.all_spans(sums, t)
    hashes &= ~low
    hashes |= at.view(np.uint64)
    least = flat.window_minima(hashes, k - t + 1)
    width = k - m + 1
    part = (width + 1) // 2
    place = (least & low).view(np.int64)
    place -= at[:windows]
    place = (np.arange(k - t + 1) % width)[place]
    right = place >= part  # where in its window the minimiser lies
    place += at[:windows]
    new = np.ones(windows, bool)
    np.not_equal(place[1:], place[:-1], out=new[1:])
    if halves:
        new[1:] |= right[1:] != right[:-1]
    new[begins] = True
    depth = np.zeros(windows + 1, np.int8)
    np.add.at(depth, begins, 1)
    np.add.at(depth, stops, -1)
    new &= np.cumsum(depth[:-1], dtype=np.int8).view(bool)
    start = np.flatnonzero(new)
    document = np.searchsorted(bounds, start, "right") - 1
    count = np.minimum(np.append(start[1:], windows), bounds[document] + room[document]) - start
    place, right = place[start], right[start]
    minimiser = flat.mix(grams.spans(sums, place, place + m) + np.uint64(m)).view(np.int64)
    if not halves:
        return document, start, count, minimiser
    if keep is not None:
        kept = np.flatnonzero(keep(document, minimiser))
        document, start, count, minimiser, place, right = (
            x[kept] for x in (document, start, count, minimiser, place, right))
    core = grams.spans(sums, np.where(right, place - part, place), np.where(right, place - width, place - part) + k + 1)
    core = flat.mix(core + right.astype(np.uint64)).view(np.int64)
    if keep_cores is not None:
        kept = np.flatnonzero(keep_cores(document, core))
        document, start, count, minimiser, core = (x[kept] for x in (document, start, count, minimiser, core))
    content = flat.rolling(_CONTENT)
    digest = content.spans(content.prefix(symbols), start, start + count + k - 1)
    return document, start, count, minimiser, core, digest.view(np.int64)


def _anchors(spec):
    """(minimiser, key, known): known rows are repeats within a slice; a row without key stands for them."""
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), _SLICE):
                found = []
                for row, _, part, cuts in flat.blocks(data, offsets, _BLOCK):
                    symbols, bounds = spec.parse(part, cuts)[:2]
                    document, _, _, minimiser = super_kmers(symbols, bounds, spec.k, spec.m, spec.t)
                    found.append((document + row, minimiser))
                document, minimiser = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(minimiser, kind="stable")  # the documents of a minimiser stay in order
                document, minimiser = document[order], minimiser[order]
                if spec.once_a_document:
                    new = np.ones(len(order), bool)
                    new[1:] = (document[1:] != document[:-1]) | (minimiser[1:] != minimiser[:-1])
                    document, minimiser = document[new], minimiser[new]
                heads = np.flatnonzero(np.append(True, minimiser[1:] != minimiser[:-1]))
                counts = np.diff(heads, append=len(minimiser))
                known = np.repeat(counts > 1, counts)
                shared = minimiser[heads[counts > 1]]
                key = batch.column("key").slice(first, n).take(pa.array(document))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([minimiser, shared])),
                     pa.concat_arrays([key, pa.nulls(len(shared), pa.int64())]),
                     pa.array(np.concatenate([known, np.zeros(len(shared), bool)]))],
                    ["minimiser", "key", "known"],
                )
    return run


def _repeated(batches):
    """Rows whose minimiser also occurs in a neighbouring row; rows come sorted by minimiser."""
    held = None  # the last row: it needs the next one
    for batch in batches:
        if not batch.num_rows:
            continue
        minimiser = batch.column("minimiser").to_numpy()
        present = batch.column("key").is_valid().to_numpy(zero_copy_only=False)
        key = batch.column("key").fill_null(0).to_numpy()
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if held is not None:
            minimiser, key = np.append(held[0], minimiser), np.append(held[1], key)
            known, present = np.append(held[2], known), np.append(held[3], present)
        same = minimiser[1:] == minimiser[:-1]
        known = known.copy()
        known[1:] |= same
        known[:-1] |= same
        held = minimiser[-1:], key[-1:], known[-1:], present[-1:]
        out = np.flatnonzero((known & present)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(minimiser[out])], ["key", "minimiser"])
    if held is not None and held[2][0] and held[3][0]:
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], ["key", "minimiser"])


def _wanted(batch, first, n, names):
    """Values of list columns of a slice, and the text of each."""
    columns = [batch.column(c).slice(first, n) for c in names]
    lengths = np.diff(columns[0].offsets.to_numpy())
    return np.repeat(np.arange(n), lengths), [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def _pair(a, b):
    return flat.mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64))


def _among(row, listed):
    """Tells which documents and minimisers (or cores) are listed."""
    pairs = np.sort(_pair(row, listed))

    def keep(document, names):
        have = _pair(document, names)
        return pairs[np.minimum(np.searchsorted(pairs, have), len(pairs) - 1)] == have
    return keep


def _candidates(spec):
    """Halves of super-k-mers whose minimiser is in the list of the row."""
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), _BLOCK):
                symbols, bounds = spec.parse(data, offsets)[:2]
                row, (listed,) = _wanted(batch, first, n, ["minimisers"])
                document, start, count, _, core, digest = super_kmers(
                    symbols, bounds, spec.k, spec.m, spec.t, True, _among(row, listed))
                rows = pa.array(document)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), pa.array(digest), batch.column("key").slice(first, n).take(rows),
                     batch.column("doc_id").slice(first, n).take(rows), batch.column("copies").slice(first, n).take(rows),
                     pa.array((start - bounds[document]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    ["core", "digest", "key", "doc_id", "copies", "start", "n"],
                )
    return run


def _fetched(spec, batches):
    """Per slice: its parsed symbols, and the first half of every class that a row is asked for."""
    names = ["cores", "digests", "counts", "leasts"]
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text"), _BLOCK):
            parsed = spec.parse(data, offsets)
            row, (listed, digests, counts, leasts) = _wanted(batch, first, n, names)
            document, start, count, _, core, digest = super_kmers(
                *parsed[:2], spec.k, spec.m, spec.t, True, keep_cores=_among(row, listed))
            have = _pair(document, flat.mix(_pair(core, digest)).view(np.int64))
            want = _pair(row, flat.mix(_pair(listed, digests)).view(np.int64))
            distinct, where = np.unique(have, return_index=True)
            if not len(distinct):
                continue
            place = np.minimum(np.searchsorted(distinct, want), len(distinct) - 1)
            hit = distinct[place] == want
            at = where[place[hit]]
            yield parsed, data, start[at], count[at], [
                pa.array(x[hit]) for x in (listed, digests, counts, leasts)]


def _strings(spec):
    def run(batches):
        for parsed, data, start, count, columns in _fetched(spec, batches):
            strings = spec.pack(parsed, data, start, start + count + spec.k - 1)
            yield pa.RecordBatch.from_arrays([*columns, strings], ["core", "digest", "c", "least", "packed"])
    return run


def _digests(spec):
    def run(batches):
        for parsed, _, start, count, columns in _fetched(spec, batches):
            row = pa.array(np.repeat(np.arange(len(start)), count))
            offset = flat.ranges(np.zeros(len(start), np.int64), count)
            at = np.repeat(start, count) + offset
            sides = []
            for seed in (_CONTENT, _SECOND):
                roller = flat.rolling(seed)
                sides.append(pa.array(roller.spans(roller.prefix(parsed[0]), at, at + spec.k).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[c.take(row) for c in columns], pa.array(offset), *sides],
                ["core", "digest", "c", "least", "offset", "h1", "h2"],
            )
    return run


def _distinct(rows):
    """One batch with one row of each class: equal rows of the table send the same strings."""
    rows = pa.concat_batches(rows)
    names = np.stack([rows.column(c).to_numpy() for c in ("core", "digest")])
    new = np.ones(rows.num_rows, bool)
    new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
    return rows.take(pa.array(np.flatnonzero(new)))


def _solved(spec):
    """Compare the windows of complete core groups, some MB at a time; rows come sorted by core and digest."""
    def out(rows):
        rows = [_distinct(rows)]
        strings = pa.concat_arrays([r.column("packed") for r in rows])
        c = np.concatenate([r.column("c").to_numpy() for r in rows])
        least = np.concatenate([r.column("least").to_numpy() for r in rows])
        row, offset, total, smallest = spec.solve(strings, c, least)
        new = np.ones(len(row), bool)  # neighbouring windows with equal results are one run
        new[1:] = ((row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
                   | (smallest[1:] != smallest[:-1]) | ((total[1:] > 1) != (total[:-1] > 1)))
        first = np.flatnonzero(new)
        length = np.diff(first, append=len(row))
        first, length = first[total[first] > 1], length[total[first] > 1]
        names = pa.concat_batches([r.select(["core", "digest"]) for r in rows]).take(pa.array(row[first]))
        return pa.RecordBatch.from_arrays(
            [*names.columns, pa.array(offset[first]), pa.array(length), pa.array(smallest[first])],
            ["core", "digest", "offset", "length", "least"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            first = 0
            core = batch.column("core").to_numpy()
            bounds = np.flatnonzero(np.diff(core)) + 1
            if held and len(core) and held[-1].column("core")[-1].as_py() != core[0] and size >= _CHUNK:
                yield out(held)
                held, size = [], 0
            offsets = flat.byte_array(batch.column("packed"))[1]
            for bound in bounds:
                if size + offsets[bound] - offsets[first] >= _CHUNK:
                    yield out([*held, batch.slice(first, bound - first)])
                    held, size, first = [], 0, bound
            if first < batch.num_rows:
                held.append(batch.slice(first))
                size += offsets[-1] - offsets[first]
        if held:
            yield out(held)
    return run


class Scratch:
    """Written intermediates of one search, by name."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df, name):
        path = self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names):
        for name in names:
            remove(self.spark, self.paths.pop(name))


def copied(documents):
    """(key, doc_id, copies, first) of every row whose text occurs in more than one; first is the smallest id. And the
    bytes of all texts."""
    seen = Observation()
    rows = documents.filter("text IS NOT NULL").select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha1("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    rows = rows.groupBy("digest", "key", "doc_id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    rows = materialise(rows.observe(seen, F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")), "rows")
    first = rows.groupBy("digest").agg(F.sum("rows").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")
    return broadcast_if_small(
        rows.join(broadcast_if_small(first), "digest").select("key", "doc_id", "copies", "first")), seen.get["bytes"]


def _buckets(spark, size):
    """As many as queries have partitions, or more if buckets of texts of that size were too large then."""
    partitions = max(int(spark.conf.get(f"spark.sql.{c}", None) or 1) for c in (
        "shuffle.partitions", "adaptive.coalescePartitions.initialPartitionNum"))
    return min(max(partitions, -(-size // BUCKET_BYTES)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def prepared(documents):
    """doc_id, text, key, long_id, and copies and first as in `copied`, NULL for a text that occurs once.

    It is a table in buckets of the key, so that joins with lists of keys leave the texts where they are.
    """
    spark, (copies, size) = documents.sparkSession, copied(documents)
    texts = documents.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("long_id"))
    same = (texts["key"] == copies["key"]) & texts["long_id"].eqNullSafe(copies["doc_id"])
    buckets = _buckets(spark, size)
    name = f"chatlens_texts_{uuid.uuid4().hex}"
    texts.join(copies, same, "left").select(texts["*"], "copies", "first").repartition(buckets, "key").write.bucketBy(
        buckets, "key").option("path", scratch_path(spark, "texts")).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    release(spark)
    return table


def _first(texts):
    """key, doc_id, text and number of copies of the first row of every text."""
    return texts.filter("copies IS NULL OR long_id <=> first").select(
        "key", F.col("long_id").alias("doc_id"), "text", F.coalesce("copies", F.lit(1)).alias("copies"))


def _dealt(lists, width, texts):
    """Lists by key for a join in the buckets of the table of texts, by hash tables, or by sorting, which may spill."""
    files = max(len(texts.inputFiles()), 1)  # one for each bucket with texts
    return lists.hint("shuffle_hash" if width <= files * HASHED_BYTES else "merge")


def _beside_texts(lists, texts):
    """Lists by key for a join with the table of texts: a broadcast, or dealt to its buckets."""
    lists, width = copy_with_width(lists)
    return F.broadcast(lists) if width <= LISTED_BYTES else _dealt(lists, width, texts)


def _asked(texts, classes):
    """Texts with the classes that each is asked for: one name for each class, the smallest key."""
    lists = classes.groupBy("key").agg(*[
        F.collect_list(c).alias(f"{c}s") for c in ("core", "digest")
    ], F.collect_list("c").alias("counts"), F.collect_list(F.coalesce("least", F.lit(LARGEST))).alias("leasts"))
    return texts.select("key", "text").join(_beside_texts(lists, texts), "key")


def repeated_windows(prepared_texts, spec):
    """(key, doc_id, copies, start, length, least): runs of windows that occur more than once.

    Of the table of `prepared` only the first row of every text is searched. least is the smallest id
    of a document with the window. Starts count symbols of the document. A run is listed for every searched
    document that holds it, the one with the smallest id included.
    """
    scratch = Scratch(prepared_texts.sparkSession)
    texts = _first(prepared_texts)
    anchors = texts.select("key", "text").mapInArrow(
        _anchors(spec), "minimiser long, key long, known boolean")
    spread = anchors.repartition(F.when(F.col("known"), F.col("key")).otherwise(F.col("minimiser")))
    shared = spread.sortWithinPartitions("minimiser").mapInArrow(_repeated, "key long, minimiser long")
    lists, seen = shared.groupBy("key").agg(F.collect_set("minimiser").alias("minimisers")), Observation()
    lists = scratch.write(lists.observe(seen, total_width(lists.schema)), "minimisers")
    found = scratch.write(texts.join(_dealt(lists, seen.get["bytes"], texts), "key").mapInArrow(
        _candidates(spec), "core long, digest long, key long, doc_id long, copies long, start int, n int"), "superkmers")
    scratch.drop("minimisers")
    classes = scratch.write(found.groupBy("core", "digest", "n").agg(
        F.sum("copies").alias("c"), F.min("doc_id").alias("least"), F.min("key").alias("key")), "classes")
    groups = classes.groupBy("core").agg(F.count("*").alias("classes"))
    sized = scratch.write(classes.join(groups, "core").filter("classes > 1 OR c > 1"), "sized")
    scratch.drop("classes")
    single = sized.filter("classes = 1").select(
        "core", "digest", F.lit(0).cast("long").alias("offset"), F.col("n").cast("long").alias("length"), "least")
    strings = _asked(texts, sized.filter((F.col("classes") > 1) & (F.col("classes") <= HOT))).mapInArrow(
        _strings(spec), "core long, digest long, c long, least long, packed binary")
    marks = "core long, digest long, offset long, length long, least long"
    solved = scratch.write(
        strings.repartition("core").sortWithinPartitions("core", "digest").mapInArrow(_solved(spec), marks), "solved")
    hot = scratch.write(_asked(texts, sized.filter(F.col("classes") > HOT)).dropDuplicates(["key"]).mapInArrow(
        _digests(spec), "core long, digest long, c long, least long, offset long, h1 long, h2 long"), "hot")
    sums = hot.groupBy("h1", "h2").agg(F.sum("c").alias("total"), F.min("least").alias("smallest")).filter("total > 1")
    counted = hot.join(sums, ["h1", "h2"]).select(
        "core", "digest", "offset", F.lit(1).cast("long").alias("length"), F.col("smallest").alias("least"))
    every = scratch.write(single.unionByName(solved).unionByName(counted), "marks")
    scratch.drop("sized", "solved", "hot")
    return found.join(every, ["core", "digest"]).select(
        "key", "doc_id", "copies", (F.col("start") + F.col("offset")).alias("start"), "length",
        F.when(F.col("least") < LARGEST, F.col("least")).alias("least"))


def with_runs(prepared_texts, whole, marks):
    """Every document with the lists of its marked runs, which may be NULL, and whether all its windows are marked.

    whole is the condition for the latter, on long_id and the columns of `copied`.
    """
    lists = _beside_texts(marks.groupBy("key").agg(F.collect_list(F.struct(
        F.col("doc_id").alias("marked_id"), "start", "length")).alias("runs")), prepared_texts)
    release(prepared_texts.sparkSession)
    own = F.filter("runs", lambda r: r["marked_id"].eqNullSafe(F.col("long_id")))
    return prepared_texts.join(lists, "key", "left").select(
        "doc_id", "text", F.transform(own, lambda r: r["start"]).alias("starts"),
        F.transform(own, lambda r: r["length"]).alias("lengths"), F.coalesce(F.expr(whole), F.lit(False)).alias("whole"))


def covered(batch, first, n, bounds, k):
    """Mask of the symbols of a slice that a marked window covers; of whole documents every window is marked."""
    lists = [batch.column(c).slice(first, n) for c in ("starts", "lengths")]
    counts = np.where(lists[0].is_valid().to_numpy(zero_copy_only=False), np.diff(lists[0].offsets.to_numpy()), 0)
    starts, lengths = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    room = np.diff(bounds) - k + 1
    whole = np.flatnonzero(batch.column("whole").slice(first, n).to_numpy(zero_copy_only=False) & (room > 0))
    low = np.concatenate([starts + np.repeat(bounds[:-1], counts), bounds[whole]]).astype(np.int64)
    lengths = np.concatenate([lengths, room[whole]]).astype(np.int64)
    depth = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(depth, low, 1)
    np.add.at(depth, low + lengths + k - 1, -1)
    return np.cumsum(depth[:-1]) > 0

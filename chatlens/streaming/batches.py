"""A log of micro-batches: one folder a batch, replaced when the batch is replayed, merged level by level.

A segment is the folder `first-last` of the batches it holds; it counts once its write has ended. After batch N is
written, the last FAN_IN segments of each full level become one, so N batches are read as about FAN_IN - 1 folders
a level, log N levels. Only the last batch of a stream is ever replayed: merges end at the batch that causes them and
are done again with it, so a replay finds every folder it needs. Folders that a merge covers go KEEP batches later,
which leaves a query that has listed them time to end; folders at or below the released position (what has been
folded into a table, say) go with the next batch.

One stream writes a log. Rows carry their batch number in `batch`.
"""

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.session import remove

FAN_IN = 8
KEEP = 8
BATCH = "batch"
_SEGMENT = re.compile(r"(\d+)-(\d+)$")
_RELEASED = re.compile(r"released-(\d+)$")


def entries(spark, root):
    """The file system that holds a folder, and what lies directly below it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return fs, []
    return fs, [status.getPath() for status in fs.listStatus(path)]


def segments(spark, root):
    """(first, last) of every segment whose write has ended."""
    fs, found = entries(spark, root)
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        tuple(map(int, m.groups())) for p in found
        if (m := _SEGMENT.match(p.getName())) and fs.exists(done(p, "_SUCCESS")))


def released(spark, root):
    """The batch up to which nothing is needed any more; -1 at first."""
    marks = [_RELEASED.match(p.getName()) for p in entries(spark, root)[1]]
    return max((int(m.group(1)) for m in marks if m), default=-1)


def release(spark, root, batch):
    """Give up batches up to a number, as they are held elsewhere now."""
    fs, found = entries(spark, root)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/released-{batch}")
    fs.mkdirs(new)
    for p in found:
        if (m := _RELEASED.match(p.getName())) and int(m.group(1)) < batch:
            fs.delete(p, True)


def cover(found, after=-1):
    """The fewest segments that hold every batch above `after`, none twice."""
    chosen = []
    for first, last in sorted(found, key=lambda s: (s[0], -s[1])):
        if last > after and (not chosen or first > chosen[-1][1]):
            chosen.append((first, last))
    return chosen


def merges_due(last):
    """Segments to be made after batch `last`, smaller ones first."""
    due, size = [], FAN_IN
    while (last + 1) % size == 0:
        due.append((last + 1 - size, last))
        size *= FAN_IN
    return due


def removable(found, last, released_at=-1):
    """Segments that a merge covers for KEEP batches by now, and those at or below the released position."""
    def covered(s):
        return any(t != s and t[0] <= s[0] and s[1] <= t[1] <= last - KEEP for t in found)

    return [s for s in found if covered(s) or s[1] <= min(released_at, last - 1)]


def segment_path(root, segment):
    return f"{root}/{segment[0]:010d}-{segment[1]:010d}"


def _with_batch(schema):
    return T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])


def read_segments(spark, root, schema, chosen):
    """Rows of segments; each is read on its own, as a segment may be laid out by a column."""
    if not chosen:
        return spark.createDataFrame([], _with_batch(schema))
    parts = [spark.read.schema(_with_batch(schema)).parquet(segment_path(root, s)) for s in chosen]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_batches(spark, root, schema, after=-1, before=None):
    """Rows of the batches after a number (where merges keep rows apart) and before another."""
    chosen = cover([s for s in segments(spark, root) if before is None or s[1] < before], after)
    rows = read_segments(spark, root, schema, chosen)
    return rows.where(F.col(BATCH) > after) if any(first <= after for first, _ in chosen) else rows


def last_batch(spark, root):
    return max((last for _, last in segments(spark, root)), default=-1)


def _write(rows, path, by, options, parts=None):
    if by:
        rows = rows.repartition(parts, by) if parts else rows.hint("rebalance", by)
    writer = rows.write.mode("overwrite").options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_batch(df, batch_id, root, merge=None, by=None, options=None, parts=None):
    """Write a batch (again), merge what is due, remove what is no longer read.

    merge(rows with their batch) -> rows with a batch; without it rows are kept as they are. With `by` a segment is
    laid out by the values of a column, by as many tasks as `parts` says; `options` are the writer's.
    """
    rows = df.withColumn(BATCH, F.lit(batch_id).cast("long"))
    _write(rows, segment_path(root, (batch_id, batch_id)), by, options or {}, parts)
    schema = T.StructType([f for f in df.schema.fields if f.name != BATCH])
    compact(df.sparkSession, batch_id, root, schema, merge, by, options)


def compact(spark, batch_id, root, schema, merge=None, by=None, options=None):
    """Merge what is due after a batch, which may have written nothing, and remove what is no longer read."""
    for first, last in merges_due(batch_id):
        inside = [s for s in segments(spark, root) if first <= s[0] and s[1] <= last and s != (first, last)]
        if inside:
            rows = read_segments(spark, root, schema, cover(inside))
            merged = (merge(rows) if merge else rows).select(*schema.names, BATCH)
            _write(merged, segment_path(root, (first, last)), by, options or {})
    found = segments(spark, root)
    for s in removable(found, batch_id, released(spark, root)):
        remove(spark, segment_path(root, s))


def latest(rows, keys):
    """Per key the row of the most recent batch, with its number."""
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, BATCH), BATCH).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*rest, BATCH)])


def start(stream, land, checkpoint, mode="append", every="30 seconds", available_now=False):
    """Run land(batch, batch_id) per micro-batch; with available_now stop at the end of input."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(land)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()

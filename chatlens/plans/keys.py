"""Known message keys (msg_id), so that no write has to look for repeats in the messages.

Each writer (a stream, a batch job) has a log of batches, whose segments lie in hash buckets. A check reads the segments' keys of those
buckets alone that the new keys fall into; where these are few, they are compared in the scan, and Parquet's bloom
filters skip what can't hold them. Writes append, and merges keep the number of folders small (see
streaming.batches). Message files are never opened.
"""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.sizing import BROADCAST_BYTES
from chatlens.streaming.batches import compact, entries, last_batch, read_batches, write_batch

BUCKETS = 16
FEW = 32
_KEY_WIDTH = 32
BUCKET = "bucket"
KEYS = T.StructType([
    T.StructField("msg_id", T.StringType()), T.StructField("id", T.LongType()), T.StructField(BUCKET, T.IntegerType())])
# filters as large as the keys of a file need
_OPTIONS = {"parquet.bloom.filter.enabled#msg_id": "true", "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.max.bytes": "262144"}


def bucket_of(column="msg_id"):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def write_keys(messages, root, writer, batch_id):
    """Append the keys of a batch's messages (again)."""
    keys = messages.select("msg_id", "id").withColumn(BUCKET, bucket_of())
    write_batch(keys, batch_id, f"{root}/{writer}", by=BUCKET, options=_OPTIONS, parts=BUCKETS)


def compact_keys(spark, root, writer, batch_id):
    """What is due after a batch without new keys."""
    compact(spark, batch_id, f"{root}/{writer}", KEYS, by=BUCKET, options=_OPTIONS)


def writers(spark, root):
    return sorted(p.getName() for p in entries(spark, root)[1])


def next_batch(spark, root, writer):
    return last_batch(spark, f"{root}/{writer}") + 1


def known_keys(spark, root, writer=None, before=None):
    """(msg_id, id, bucket, batch) of all writers; of one writer only the batches before a number."""
    logs = [read_batches(spark, f"{root}/{w}", KEYS, before=before if w == writer else None) for w in writers(spark, root)]
    return reduce(lambda a, b: a.unionByName(b), logs) if logs else spark.createDataFrame([], KEYS)


def stored_again(rows, root, writer=None, before=None, broadcast_bytes=None):
    """The keys among the rows' msg_id that are known already, with the id they were given."""
    wanted = rows.select("msg_id").where("msg_id IS NOT NULL").withColumn(BUCKET, bucket_of())
    asked = wanted.agg(F.collect_set(BUCKET).alias("buckets"), F.count("*").alias("n"),  # BUCKETS numbers at most
                       F.coalesce(F.sum(F.octet_length("msg_id") + _KEY_WIDTH), F.lit(0)).alias("bytes")).first()
    known = known_keys(rows.sparkSession, root, writer, before)
    known = known.where(F.col(BUCKET).isin(asked["buckets"]) if asked["n"] else F.lit(False))
    if asked["n"] <= FEW:
        hits = [F.col("msg_id") == r["msg_id"] for r in wanted.collect()]
        return known.where(reduce(lambda a, b: a | b, hits, F.lit(False))).select("msg_id", "id")
    if asked["bytes"] <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        wanted = F.broadcast(wanted)
    return known.join(wanted, ["msg_id", BUCKET], "left_semi").select("msg_id", "id")

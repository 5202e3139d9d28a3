"""Streaming stance timeline in fixed buckets.

The state is one row of counters per bucket, so by default it is kept for good and no message
is ever late. With `delay` old buckets are dropped from the state, and messages that come later
than that are not counted.
"""

from pyspark.sql import functions as F

from chatlens.operators.timeline import stance_buckets, unfold
from chatlens.streaming.batches import BATCH, latest, read_batches, start, write_batch


def counted(stream, width="15 minutes", delay=None):
    # a watermark needs a timestamp with zone; the session zone applies both ways
    timed = stream.withColumn("dt_stamp", F.col("dt_stamp").cast("timestamp"))
    if delay:
        timed = timed.withWatermark("dt_stamp", delay)
    return stance_buckets(timed, width)


def _newest(rows):
    return latest(rows, ["bucket_start"])


def stream_stance_timeline(visible, root, checkpoint, width="15 minutes", delay=None, **options):
    """Each micro-batch writes the buckets it changed."""
    buckets = counted(visible, width, delay)
    return start(buckets, lambda batch, n: write_batch(batch, n, root, _newest), checkpoint, "update", **options)


def streamed_timeline(spark, root, schema):
    """The timeline as of the last micro-batch."""
    buckets = _newest(read_batches(spark, root, schema)).drop(BATCH)
    return unfold(buckets).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))

"""Late messages: a timeline whose buckets close, and what comes for a bucket after that.

A bucket is closed when a message `delay` newer than its end was seen in an earlier micro-batch. On-time messages are
counted per bucket; a message of a closed bucket goes to a side table instead, where it is listed and counted. The
repaired timeline adds the counters of the side table's messages to just the buckets they fall into; it equals
the batch timeline of all messages. State are logs merged level by level: counters, late messages, newest time.
"""

from pyspark.sql import functions as F

from chatlens.operators.timeline import merged_buckets, stance_buckets, unfold
from chatlens.session import materialise, passing_copies
from chatlens.streaming.batches import BATCH, read_batches, start, write_batch


def _summed(rows):
    batch = rows.groupBy().agg(F.max(BATCH).alias(BATCH))
    return merged_buckets(rows.drop(BATCH)).withColumn(BATCH, batch.scalar())


def _latest(rows):
    return rows.agg(F.max("seen").alias("seen"), F.max(BATCH).alias(BATCH))


_SEEN = "seen timestamp_ntz"


class LateTimeline:
    """A stance timeline in buckets of one width, below a folder."""

    def __init__(self, visible, root, width="15 minutes", delay="1 hour"):
        self.spark, self.schema = visible.sparkSession, visible.schema
        self.root, self.width, self.delay = root, width, delay
        self.buckets = stance_buckets(self.spark.createDataFrame([], self.schema), width).schema

    def _closed_before(self, batch_id):
        """Buckets that end at or before this time are closed for a batch; NULL for the first one."""
        seen = self.spark.createDataFrame([], _SEEN).schema
        clock = read_batches(self.spark, f"{self.root}/clock", seen, before=batch_id)
        return clock.agg((F.max("seen") - F.expr(f"INTERVAL {self.delay}")).alias("at")).first()["at"]

    def land(self, batch, batch_id):
        """Count a batch (again): its on-time messages by bucket, its late ones aside."""
        with passing_copies(self.spark):
            batch = materialise(batch, "batch")
            closed = self._closed_before(batch_id)
            late = F.lit(False)
            if closed is not None:
                late = F.coalesce(F.window("dt_stamp", self.width)["end"] <= F.lit(closed).cast("timestamp_ntz"), F.lit(False))
            marked = materialise(batch.withColumn("_late", late), "marked")
            write_batch(stance_buckets(marked.where("NOT _late").drop("_late"), self.width), batch_id, f"{self.root}/buckets", _summed)
            write_batch(marked.where("_late").drop("_late"), batch_id, f"{self.root}/late")
            write_batch(batch.agg(F.max("dt_stamp").cast("timestamp_ntz").alias("seen")), batch_id, f"{self.root}/clock", _latest)

    def start(self, stream, checkpoint, **options):
        return start(stream, self.land, checkpoint, **options)

    def late_messages(self):
        """The messages that came after their bucket was closed, with the batch they came in."""
        return read_batches(self.spark, f"{self.root}/late", self.schema)

    def late_counts(self):
        """How many late messages each bucket has missed."""
        bucket = F.window("dt_stamp", self.width)["start"].alias("bucket_start")
        return self.late_messages().groupBy(bucket).agg(F.count("*").alias("late"))

    def _counted(self):
        return read_batches(self.spark, f"{self.root}/buckets", self.buckets).drop(BATCH)

    def timeline(self):
        """As it was when its buckets closed."""
        return unfold(merged_buckets(self._counted()))

    def repaired(self):
        """With the late messages in the buckets they belong to."""
        missed = stance_buckets(self.late_messages().drop(BATCH), self.width)
        return unfold(merged_buckets(self._counted().unionByName(missed)))

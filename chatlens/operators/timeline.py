"""Stance counts over time.

Rows are first folded into one row per time bucket with a handful of counters, so what is
shuffled is the number of buckets, however many messages a bucket or a video holds.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.functions.time import bucket_minutes, bucket_of_minute
from chatlens.operators.metrics import as_rows
from chatlens.schema import STANCES
from chatlens.session import materialise


def _present(df):
    return [s for s in STANCES if s in df.columns]


def _counter_names(stances):
    return [f"{s}_{c}" for s in stances for c in ("seen", "favor", "against")]


def bucket_counters(stances):
    counters = []
    for s in stances:
        counters += [
            f"count({s}) AS {s}_seen",
            f"count_if({s} = 'Favor') AS {s}_favor",
            f"count_if({s} = 'Against') AS {s}_against",
        ]
    return [F.expr(c) for c in counters]


def stance_buckets(visible, width="15 minutes", by=()):
    """One row per bucket (and key): counters of all stances. Rows without a time drop out."""
    bucket = F.window("dt_stamp", width).alias("bucket")
    return (
        visible.groupBy(*by, bucket).agg(*bucket_counters(_present(visible)))
        .withColumn("bucket_start", F.col("bucket.start")).drop("bucket")
    )


def merged_buckets(buckets, by=()):
    """Bucket counters of parts of the messages, added up."""
    keys = [*by, "bucket_start"]
    return buckets.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in buckets.columns if c not in keys])


def unfold(buckets, by=()):
    """One row per stance and bucket.

    A bucket exists for a stance when any message in it carries that stance, even a neutral
    one (then with 0, 0); a bucket without such a message does not exist.
    """
    stances = [s for s in STANCES if f"{s}_seen" in buckets.columns]
    keys = [*by, "bucket_start"]
    rows = [[*keys, f"'{s}'", f"{s}_seen", f"{s}_favor", f"{s}_against"] for s in stances]
    return (
        as_rows(buckets, [*keys, "stance", "seen", "favor", "against"], rows)
        .where("seen > 0").drop("seen")
    )


def stance_timeline(visible, width="15 minutes", by=()):
    """Favor and against counts per fixed time bucket and stance."""
    return unfold(stance_buckets(visible, width, by), by)


def minute_counters(visible, by=()):
    """One row per minute (and key): counters of all stances, and the first and last time in it."""
    return visible.where("dt_stamp IS NOT NULL").groupBy(*by, F.window("dt_stamp", "1 minute").alias("bucket")).agg(
        *bucket_counters(_present(visible)),
        F.min("dt_stamp").alias("first_at"), F.max("dt_stamp").alias("last_at"),
    ).withColumn("minute", F.col("bucket.start")).drop("bucket")


def merged_minutes(minutes, by=()):
    """Minute counters of parts of the messages, added up."""
    counters = [c for c in _counter_names(STANCES) if c in minutes.columns]
    return minutes.groupBy(*by, "minute").agg(
        *[F.sum(c).alias(c) for c in counters], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def rolled_up(minutes, by=()):
    """The timeline from minute counters, in buckets whose width follows from the time span.

    Every width is a whole number of minutes, so a minute belongs to one bucket. With keys, each key has its own
    span and width. The minutes are read twice.
    """
    by = list(by)
    if by:
        # One row per key and minute is left, so a key's window holds minutes, not messages.
        w = Window.partitionBy(*by)
        width = bucket_minutes(F.max("last_at").over(w) - F.min("first_at").over(w))
    else:
        ends = minutes.agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        width = ends.select(bucket_minutes(F.col("last_at") - F.col("first_at")).alias("w")).scalar()
    counters = [c for c in _counter_names(STANCES) if c in minutes.columns]
    merged = (
        minutes.withColumn("width", width)
        .withColumn("bucket_start", bucket_of_minute(F.col("minute"), F.col("width")))
        .groupBy(*by, "width", "bucket_start").agg(*[F.sum(c).alias(c) for c in counters])
    )
    return unfold(merged, [*by, "width"])


def stance_timeline_adaptive(visible, by=()):
    """As stance_timeline, with the bucket width following from the time span."""
    minutes = minute_counters(visible, by)
    return rolled_up(minutes if by else materialise(minutes, "minutes"), by)  # the messages are read once


def stance_peaks(visible, width="15 minutes"):
    """The highest favor or against count any bucket reaches, per stance."""
    stances = _present(visible)
    peaks = stance_buckets(visible, width).agg(*[
        F.expr(f"max(greatest({s}_favor, {s}_against)) AS {s}") for s in stances
    ])
    return as_rows(peaks, ["stance", "peak"], [[f"'{s}'", s] for s in stances])

"""Time expressions: lenient parse, local clock, bucket starts."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.schema import BUCKET_RULES, WIDEST_BUCKET

DISPLAY_ZONE = "Asia/Singapore"


def lenient_timestamp(column):
    """Timestamp without zone, NULL where the text is none; judged row by row."""
    return F.col(column).try_cast("timestamp_ntz")


def moment(value):
    """A given time ('2024-02-01 00:00:00', a datetime without zone, or a column)."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("timestamp_ntz")


def local_clock(ts_utc, zone=DISPLAY_ZONE):
    """HH:mm:ss in a zone, of a UTC time without zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts_utc)
    return F.date_format(local, "HH:mm:ss")


def minutes_between(start, end):
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)


def bucket_minutes(span):
    """Bucket width in minutes for a time span (an interval column)."""
    return reduce(
        lambda wider, rule: F.when(
            span <= F.make_dt_interval(mins=F.lit(rule[0])), F.lit(rule[1])
        ).otherwise(wider),
        reversed(BUCKET_RULES),
        F.lit(WIDEST_BUCKET),
    )


def bucket_of_minute(minute, width):
    """Start of the bucket of `width` minutes, counted from midnight, that holds a minute."""
    of_day = F.hour(minute) * 60 + F.minute(minute)
    return minute - F.make_dt_interval(mins=of_day % width)

"""Which messages and registry rows a view shows."""

from functools import reduce

from pyspark.sql import functions as F

from chatlens.functions.text import long_enough, video_key
from chatlens.schema import DOMAINS, FLAGS
from chatlens.sizing import broadcast_if_small


def not_deleted():
    """Only an explicit true hides a message; missing and false do not."""
    return ~F.coalesce(F.col("delete"), F.lit(False))


def backlog_messages(messages):
    """Not labelled yet and long enough; deleted messages stay in."""
    return messages.where(~F.col("enriched") & long_enough(messages))


def backlog_limit(messages, n):
    """The n oldest ids of the backlog, for one labelling batch."""
    return backlog_messages(messages).orderBy("id").limit(n)


def visible_messages(messages):
    """Labelled, long enough, not deleted."""
    return messages.where(F.col("enriched") & long_enough(messages) & not_deleted())


def video_keys(urls, broadcast_bytes=None):
    """Distinct video keys of a URL list, to join against; URLs without a key drop out."""
    keys = urls.select(video_key("url").alias("vid_id")).where("vid_id IS NOT NULL")
    return broadcast_if_small(keys.distinct(), broadcast_bytes)


def messages_for_videos(messages, urls, broadcast_bytes=None):
    """Labelled, long enough messages of the listed videos; deleted messages stay in."""
    labelled = messages.where(F.col("enriched") & long_enough(messages))
    return labelled.join(video_keys(urls, broadcast_bytes), "vid_id", "left_semi").select(*messages.columns)


def active_urls(registry):
    return registry.where(F.col("status") == "start").select("url")


def registry_status(registry, url):
    """Status of one URL: one row, or none."""
    return registry.where(F.col("url") == url).select("status")


def select_by_key(rows, keys, key, broadcast_bytes=None):
    """Rows whose key is in a list."""
    wanted = broadcast_if_small(keys.select(key).distinct(), broadcast_bytes)
    return rows.join(wanted, key, "left_semi").select(*rows.columns)


def domain_violations(messages):
    """One row per required label that is missing or outside its domain."""
    allowed = reduce(
        lambda rest, item: F.when(F.col("field") == item[0], F.col("value").isin(item[1])).otherwise(rest),
        DOMAINS.items(),
        F.lit(False),
    )
    labels = messages.unpivot("id", list(DOMAINS), "field", "value")
    return labels.where(F.col("value").isNull() | ~allowed)


def flags_as_boolean(df, names=FLAGS):
    """A missing flag counts as false."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})

"""The registry of watched URLs and what deleting from it does to messages."""

from pyspark.sql import functions as F

from chatlens.operators.filters import video_keys
from chatlens.operators.upsert import keyed_upsert
from chatlens.sizing import broadcast_if_small, is_small


def _url_list(urls, broadcast_bytes=None):
    return broadcast_if_small(urls.select("url").distinct(), broadcast_bytes)


def registry_upsert(registry, urls, platform="YouTube", broadcast_bytes=None, order=()):
    """Add URLs, or restart those already listed. A platform column in urls is kept.

    Of several platforms for a URL the last in `order` wins; without an order the last by name.
    """
    given = F.coalesce("platform", F.lit(platform)) if "platform" in urls.columns else F.lit(platform)
    changes = (
        urls.withColumn("platform", given).groupBy("url")
        .agg(F.max_by("platform", F.struct(*order, "platform")).alias("platform"))
        .select("url", F.struct("platform", F.lit("start").alias("status")).alias("_new"))
    )
    return keyed_upsert(registry, changes, "url", small=is_small(urls, broadcast_bytes))


def registry_upsert_counts(registry, urls):
    """How many of the URLs are new, and how many were listed already."""
    listed = registry.select("url", F.lit(True).alias("listed"))
    return urls.select("url").distinct().join(listed, "url", "left").agg(
        F.count_if(F.col("listed").isNull()).alias("inserted"),
        F.count("listed").alias("updated"),
    )


def registry_set_status(registry, urls, status, broadcast_bytes=None):
    """Set the status of listed URLs; URLs that are not registered are ignored."""
    if status not in ("start", "stopped"):
        raise ValueError(f"unknown status {status!r}")
    listed = _url_list(urls, broadcast_bytes).withColumn("listed", F.lit(True))
    new = F.when(F.col("listed"), F.lit(status)).otherwise(F.col("status"))
    return registry.join(listed, "url", "left").withColumn("status", new).select(*registry.columns)


def registry_delete(registry, urls, broadcast_bytes=None):
    return registry.join(_url_list(urls, broadcast_bytes), "url", "left_anti").select(*registry.columns)


def _with_hit(messages, urls, broadcast_bytes=None):
    keys = video_keys(urls, broadcast_bytes).withColumn("_hit", F.lit(True))
    return messages.join(keys, "vid_id", "left")


def soft_delete(messages, urls, broadcast_bytes=None):
    """Mark all messages of the URLs' videos deleted; the rest keeps its mark."""
    mark = F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("delete"))
    return _with_hit(messages, urls, broadcast_bytes).withColumn("delete", mark).select(*messages.columns)


def soft_delete_counts(messages, urls, broadcast_bytes=None):
    """Messages of the URLs' videos, and how many of them a delete would change."""
    changed = F.col("_hit") & ~F.coalesce(F.col("delete"), F.lit(False))
    return _with_hit(messages, urls, broadcast_bytes).agg(
        F.count("_hit").alias("matched"), F.count_if(changed).alias("modified")
    )


def delete_counts(registry, messages, urls, broadcast_bytes=None):
    """Registry rows and messages a delete of the URLs affects."""
    listed = _url_list(urls, broadcast_bytes)
    gone = registry.join(listed, "url", "left_semi").agg(F.count("*").alias("deleted_count"))
    changed = soft_delete_counts(messages, urls, broadcast_bytes)
    return changed.select(F.col("modified").alias("modified_count")).withColumn(
        "deleted_count", gone.scalar()
    )

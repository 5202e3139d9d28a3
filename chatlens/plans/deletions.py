"""Deleted videos as a small table beside the messages: applied on read, folded into the blocks later.

A delete writes one row per video, with the newest message id at that time, so that messages which come later stay
shown; the message files are not touched. Where the table fits a broadcast (it is measured) reading costs no
shuffle. A fold marks the rows in the blocks it concerns and gives up what it has folded.
"""

from pyspark.sql import functions as F

from chatlens.operators.filters import not_deleted, video_keys
from chatlens.plans.layout import read_table, rewrite_blocks
from chatlens.session import passing_copies
from chatlens.sizing import broadcast_if_small
from chatlens.streaming.batches import BATCH, last_batch, read_batches, release, released, write_batch

_DELETED = "vid_id string, upto long"


def _log(path):
    return f"{path.rstrip('/')}_deleted"


def newest_id(spark, path):
    """The greatest id of the table, from its last block alone."""
    table = read_table(spark, path)
    block = table.agg(F.max("id_block").alias("b")).first()["b"]
    return None if block is None else table.where(F.col("id_block") == block).agg(F.max("id").alias("i")).first()["i"]


def delete_videos(spark, path, urls, upto=None):
    """Delete the messages of the URLs' videos: all up to now, or up to an id."""
    upto = newest_id(spark, path) if upto is None else upto
    if upto is not None:
        with passing_copies(spark):
            rows = video_keys(urls).select("vid_id", F.lit(upto).cast("long").alias("upto"))
            write_batch(rows, last_batch(spark, _log(path)) + 1, _log(path))


def deletions(spark, path, upto=None):
    """(vid_id, upto) of the deletes that have not been folded."""
    log = _log(path)
    schema = spark.createDataFrame([], _DELETED).schema
    rows = read_batches(spark, log, schema, released(spark, log))
    rows = rows if upto is None else rows.where(F.col(BATCH) <= upto)
    return rows.groupBy("vid_id").agg(F.max("upto").alias("upto"))


def marked(messages, deleted, broadcast_bytes=None):
    """Messages with the deletes applied to their mark."""
    listed = broadcast_if_small(deleted, broadcast_bytes).withColumnRenamed("upto", "_upto")
    mark = F.when(F.col("id") <= F.col("_upto"), F.lit(True)).otherwise(F.col("delete"))
    return messages.join(listed, "vid_id", "left").withColumn("delete", mark).select(*messages.columns)


def shown(messages, deleted, broadcast_bytes=None):
    """Messages that neither their mark nor a delete hides."""
    listed = broadcast_if_small(deleted, broadcast_bytes).select(F.col("vid_id").alias("_vid"), "upto")
    gone = (F.col("vid_id") == F.col("_vid")) & (F.col("id") <= F.col("upto"))
    return messages.where(not_deleted()).join(listed, gone, "left_anti")


def read_marked(spark, path):
    """The message table as it is after all deletes."""
    return marked(read_table(spark, path), deletions(spark, path))


def fold_deletions(spark, path, block_rows=None):
    """Mark deleted messages in the blocks where that changes a row; done again it changes nothing."""
    log = _log(path)
    upto = last_batch(spark, log)
    if upto > released(spark, log):
        deleted = deletions(spark, path, upto)
        with passing_copies(spark):
            open_rows = read_table(spark, path).where(not_deleted()).select("id", "vid_id", "id_block")
            hits = open_rows.join(broadcast_if_small(deleted), "vid_id").where("id <= upto")
            rewrite_blocks(spark, path, hits.select("id_block"), lambda rows: marked(rows, deleted), block_rows)
        release(spark, log, upto)

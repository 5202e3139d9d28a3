"""Streaming ingest: repeats out, dense ids on, no message lost.

The store is a folder: `landed` holds the messages of each micro-batch, `keys` the keys of all messages (plans.keys),
`ids` the ledger of id ranges (plans.ledger). A micro-batch reads the keys its own keys could be among and the latest
ledger entry, so its cost doesn't follow from what was landed before; no message file of an earlier batch is
opened. Replayed, it finds its id range in the ledger and replaces what it wrote. `fold_landed` moves landed
messages into the message table.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.ingest import first_wins, sequence_ids
from chatlens.plans.keys import compact_keys, next_batch, stored_again, write_keys
from chatlens.plans.layout import insert_messages
from chatlens.plans.ledger import reserve_ids
from chatlens.schema import MESSAGES, SUPPLIED
from chatlens.session import materialise, passing_copies
from chatlens.streaming.batches import BATCH, compact, last_batch, read_batches, release, released, start, write_batch

LANDED = T.StructType([f for f in MESSAGES.fields if f.name in ("id", *SUPPLIED, "enriched")])
ORDER = ["dt_stamp", "msg_id"]


def drop_recent_repeats(stream, horizon="1 day"):
    """Drop a msg_id seen before within the horizon.

    The watermark runs on arrival time, so the state is bounded and no message counts as late,
    whatever its own time says.
    """
    return (
        stream.where("msg_id IS NOT NULL").select(*SUPPLIED, F.current_timestamp().alias("_seen"))
        .withWatermark("_seen", horizon)
        .dropDuplicatesWithinWatermark(["msg_id"])
        .drop("_seen")
    )


def know_stored(stored, root, writer="stored"):
    """Enter the keys of messages stored elsewhere, once, and start the ids after theirs."""
    spark = stored.sparkSession
    if next_batch(spark, f"{root}/keys", writer) == 0:
        last = stored.agg(F.max("id").alias("last")).first()["last"] or 0
        reserve_ids(spark, f"{root}/ids", writer, 0, 0, at_least=last + 1)
        write_keys(stored.where("msg_id IS NOT NULL"), f"{root}/keys", writer, 0)


def land_batch(batch, batch_id, root, writer="stream"):
    """Land the messages of a batch (again) that are not known yet, under the next free ids."""
    spark = batch.sparkSession
    with passing_copies(spark):
        batch = materialise(batch.select(*SUPPLIED).where("msg_id IS NOT NULL"), "batch")  # several passes follow
        if batch.isEmpty():  # as often: streams run batches without data to clear their state
            compact(spark, batch_id, f"{root}/landed/{writer}", LANDED)
            return compact_keys(spark, f"{root}/keys", writer, batch_id)
        known = stored_again(batch, f"{root}/keys", writer, batch_id).select("msg_id")
        fresh = first_wins(batch, "msg_id", ORDER).join(known, "msg_id", "left_anti")
        numbered = sequence_ids(
            fresh, ORDER, lambda n: reserve_ids(spark, f"{root}/ids", writer, batch_id, n) - 1,
        ).withColumn("enriched", F.lit(False))
        write_batch(numbered.select(*LANDED.names), batch_id, f"{root}/landed/{writer}")
        write_keys(numbered, f"{root}/keys", writer, batch_id)


def stream_ingest(stream, stored, root, checkpoint, horizon="1 day", writer="stream", **options):
    """Land new messages in the store at root; repeats older than the horizon are found among the known keys.

    `stored` are the messages of before. Several streams may share a store, each under a writer's name of its own, as
    long as one message comes by one stream.
    """
    know_stored(stored, root)
    return start(
        drop_recent_repeats(stream, horizon), lambda batch, n: land_batch(batch, n, root, writer), checkpoint, **options)


def landed_messages(spark, root, writer="stream"):
    """What has been landed and not been folded yet."""
    landed = f"{root}/landed/{writer}"
    return read_batches(spark, landed, LANDED, released(spark, landed)).drop(BATCH)


def fold_landed(spark, root, path, block_rows=None, writer="stream"):
    """Move landed messages into the message table; done again after a failure it changes nothing.

    Only the blocks of the new ids are written: ids are consecutive, so one of them may hold older rows.
    """
    landed = f"{root}/landed/{writer}"
    upto, after = last_batch(spark, landed), released(spark, landed)
    if upto > after:
        rows = read_batches(spark, landed, LANDED, after).where(F.col(BATCH) <= upto)
        insert_messages(spark, path, rows, block_rows)
        release(spark, landed, upto)

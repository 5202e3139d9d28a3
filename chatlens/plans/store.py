"""Writes of whole messages that refuse repeats: ids and msg_ids stay unique in the table."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.plans.keys import next_batch, stored_again, write_keys
from chatlens.plans.layout import ids_of_blocks, insert_messages, table_exists
from chatlens.plans.ledger import reserve_ids
from chatlens.schema import SUPPLIED
from chatlens.session import materialise
from chatlens.sizing import broadcast_if_small

# In this order: a row is refused for the first reason that holds.
REASONS = ["no id or msg_id", "msg_id repeated", "id repeated", "msg_id stored", "id stored"]


def _again(keys, order):
    """Whether a row comes after another one with the same keys; of a key with very many rows only places move."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1


def append_unique(messages, path, root, order=("dt_stamp", "message"), block_rows=None, writer="append", batch=None):
    """Append messages (id and what a collector supplies) unless their id or msg_id is known; the refused ones, each
    with its reason.

    Of rows with equal keys in the batch the first in `order` is taken. The store at `root` holds the keys and the
    ledger of ids, which goes on after the ids given here. A batch that failed is repeated under its number.
    """
    spark = messages.sparkSession
    batch = next_batch(spark, f"{root}/keys", writer) if batch is None else batch
    keyed = F.col("id").isNotNull() & F.col("msg_id").isNotNull()
    rows = messages.select("id", *SUPPLIED)
    marked = rows.where(keyed).withColumn("_msg_again", _again(["msg_id"], ["id", *order]))
    marked = materialise(marked.withColumn("_id_again", ~F.col("_msg_again") & _again(
        ["id", "_msg_again"], ["msg_id", *order])), "marked")
    known = broadcast_if_small(stored_again(marked, f"{root}/keys", writer, batch).select(
        "msg_id", F.lit(True).alias("_msg_known")).distinct())
    marked = marked.join(known, "msg_id", "left")
    if table_exists(spark, path):
        stored = ids_of_blocks(spark, path, marked).select("id", F.col("msg_id").alias("_other"))
        marked = marked.join(stored, "id", "left")  # one row for each id, as ids are unique in the table
    else:
        marked = marked.withColumn("_other", F.lit(None).cast("string"))
    reason = F.lit(None).cast("string")
    holds = [F.col("_msg_again"), F.col("_id_again"), F.coalesce("_msg_known", F.lit(False)), F.col("_other") != F.col("msg_id")]
    for name, condition in reversed(list(zip(REASONS[1:], holds))):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    judged = materialise(marked.select("id", *SUPPLIED, reason.alias("reason")), "judged")
    fresh = judged.where("reason IS NULL").drop("reason")
    last = fresh.agg(F.max("id").alias("last")).first()["last"]
    if last is not None:
        reserve_ids(spark, f"{root}/ids", writer, batch, 0, at_least=last + 1)
        insert_messages(spark, path, fresh, block_rows)
    write_keys(fresh, f"{root}/keys", writer, batch)
    without = rows.where(~keyed).withColumn("reason", F.lit(REASONS[0]))
    return judged.where("reason IS NOT NULL").unionByName(without)

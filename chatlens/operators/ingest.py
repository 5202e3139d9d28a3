"""New messages: duplicates out, dense ids on."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.schema import SUPPLIED
from chatlens.session import materialise
from chatlens.sizing import is_small

_POSITION_BITS = 33  # monotonically_increasing_id: task number above, row number below


def first_wins(rows, key, order):
    """One row per key: the one that comes first in `order`.

    The rank limit is applied before the shuffle as well, so of a key that fills a third of the
    batch each task sends one row. The result stays partitioned by the key for the next join.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def not_stored(rows, stored, key, small=False):
    """Rows whose key is not in `stored` yet.

    With `small` the stored keys are scanned in place, against a broadcast of the new keys,
    and only the few that occur again are shuffled.
    """
    known = stored.select(key)
    if small:
        known = known.join(F.broadcast(rows.select(key)), key, "left_semi").distinct()
    return rows.join(known, key, "left_anti")


def sequence_ids(rows, order, start=0, name="id"):
    """Number rows start + 1, start + 2, ... in `order`, without gaps and without one big task.

    Rows are range partitioned and sorted, written once with their place in the partition,
    and shifted by the sizes of the partitions before. The written copy fixes the numbers:
    a lost executor cannot change them. `order` must be unique. `start` may be a function that gets the number of rows.
    """
    place = F.monotonically_increasing_id()
    placed = materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place),
        "sequence",
    )
    if callable(start):
        start = start(placed.count())
    part = F.shiftright("_place", _POSITION_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
        # one row per partition of the written copy
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    base = start if hasattr(start, "cast") else F.lit(start).cast("long")
    row = F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        placed.withColumn("_part", part).join(F.broadcast(shift), "_part")
        .withColumn(name, base + F.col("_shift") + row + 1)
        .select(name, *rows.columns)
    )


def ingest_new_messages(stored, incoming, order=("arrival", "msg_id"), last_id=None, broadcast_bytes=None):
    """The messages of a batch that are not stored yet, numbered on from the last id.

    The first copy of a msg_id in the batch wins, stored ones are skipped. Rows without a msg_id
    can't be told apart and are left to `ingest_rejects`. Append the result to the message table.
    """
    if last_id is None:
        last_id = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    wanted = list(dict.fromkeys([*SUPPLIED, *order]))
    batch = incoming.select(*wanted).where("msg_id IS NOT NULL")
    small = is_small(batch.select("msg_id"), broadcast_bytes)
    fresh = not_stored(first_wins(batch, "msg_id", order), stored, "msg_id", small)
    numbered = sequence_ids(fresh, list(order), last_id)
    return numbered.select("id", *SUPPLIED).withColumn("enriched", F.lit(False))


def ingest_rejects(incoming):
    """The messages of a batch that can't be stored: those without a msg_id."""
    return incoming.where("msg_id IS NULL")


def ingest_counts(incoming, inserted):
    """How many messages of a batch were added, how many were rejected, and how many were repeats."""
    added = inserted.agg(F.count("*").alias("inserted"))
    received = incoming.agg(F.count("*").alias("received"), F.count_if(F.isnull("msg_id")).alias("rejected"))
    return received.withColumn("inserted", added.scalar()).select(
        "received", "inserted", (F.col("received") - F.col("inserted") - F.col("rejected")).alias("skipped"), "rejected"
    )

"""Label write-back as a log of updates, merged when read or folded into the table.

The log is one sequence of positions: micro-batch 0, corrections made after it in their turn, micro-batch 1, ... A
message keeps the position of the last write that was applied to it, and only a later write changes it. Batches and
corrections can so be folded late, again, and in any order; the table is that of one ordered batch. No
clock is compared. Every write carries all labels (a position is one of the whole row) and its own stamp.

A micro-batch costs what its updates cost; the message table is not touched until a fold.
"""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.time import moment
from chatlens.operators.upsert import enrichment_upsert, last_wins
from chatlens.plans.layout import apply_label_updates
from chatlens.schema import LABELS, POSITION
from chatlens.streaming.batches import (
    BATCH, entries, last_batch, latest, read_batches, release, released, start, write_batch,
)

STAMP = "dt_enriched"
_CORRECTION = re.compile(r"(\d+)-(\d+)-(.+)$")
_FOLDED = "_FOLDED"


def log_schema(updates):
    return T.StructType([*updates.fields, T.StructField(STAMP, T.TimestampNTZType())])


def _complete(updates):
    missing = {"id", *LABELS} - {*updates.columns}
    if missing:
        raise ValueError(f"label updates need {', '.join(sorted(missing))}")


def _stamp(as_of):
    return F.current_timestamp().cast("timestamp_ntz") if as_of is None else moment(as_of).cast("timestamp_ntz")


def _newest(rows):
    return latest(rows, ["id"])


def stream_label_updates(updates, root, checkpoint, order=("seq",), as_of=None, **options):
    """Log the last update per message of each micro-batch, stamped with its time or `as_of`."""
    _complete(updates)
    values = [c for c in updates.columns if c != "id"]

    def land(batch, batch_id):
        final = last_wins(batch, "id", values, order).select("id", "_new.*")
        write_batch(final.select(*updates.columns).withColumn(STAMP, _stamp(as_of)), batch_id, root, _newest)

    return start(updates, land, checkpoint, **options)


def _corrections(spark, root):
    """(position, name, folder) of every correction whose write has ended, and whether it has been folded."""
    fs, found = entries(spark, f"{root}/corrections")
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        ((int(m.group(1)) - 1, int(m.group(2))), m.group(3), p.toString(), fs.exists(path(p, _FOLDED)))
        for p in found if (m := _CORRECTION.match(p.getName())) and fs.exists(path(p, "_SUCCESS")))


def log_correction(spark, root, changed, name, as_of=None):
    """Log a reviewer's changes (id and all labels) after the batches written so far; the rows with their position.

    The name makes a repetition harmless: a correction that is in the log already keeps its place and its rows. One
    reviewer's write at a time: two at once could take the same turn.
    """
    _complete(changed)
    if not name:
        raise ValueError("a logged correction needs a name")
    known = _corrections(spark, root)
    folder = next((p for _, n, p, _ in known if n == name), None)
    if folder is None:
        after = last_batch(spark, root)
        turn = 1 + max((t for (b, t), *_ in known if b == after), default=0)
        folder = f"{root}/corrections/{after + 1:010d}-{turn:06d}-{name}"  # numbers from 0: after may be -1
        place = {POSITION[0]: F.lit(after).cast("long"), POSITION[1]: F.lit(turn).cast("long")}
        changed.select("id", *LABELS).withColumns({STAMP: _stamp(as_of), **place}).write.parquet(folder)
    return spark.read.parquet(folder)


def logged_updates(spark, root, schema, after=None):
    """Logged writes with their positions: batches after a number (by default those not folded yet) and corrections
    made after them; `schema` is that of the updates."""
    folded = after is None
    after = released(spark, root) if folded else after
    place = {POSITION[0]: F.col(BATCH), POSITION[1]: F.lit(0).cast("long")}
    rows = read_batches(spark, root, log_schema(schema), after).withColumns(place).drop(BATCH)
    folders = [p for (b, _), _, p, done in _corrections(spark, root) if (not done if folded else b >= after)]
    if not folders:
        return rows
    kept = T.StructType([f for f in rows.schema.fields if f.name in ("id", *LABELS, STAMP, *POSITION)])
    return rows.unionByName(spark.read.schema(kept).parquet(*folders), allowMissingColumns=True)


def current_messages(messages, log, as_of=None):
    """The message table with the log applied: the write that comes last in the log wins."""
    return enrichment_upsert(messages, log, as_of, POSITION)


def fold_updates(spark, path, log, as_of=None, block_rows=None):
    """Write logged updates, any part of the log, into the message table."""
    apply_label_updates(spark, path, log, as_of, POSITION, block_rows)


def fold_log(spark, path, root, schema, as_of=None, block_rows=None):
    """Fold all of the log that isn't folded yet, then give up what has been folded.

    Updates that are logged meanwhile wait for the next fold; a fold that failed is simply done again.
    """
    upto = last_batch(spark, root)
    known = [p for *_, p, done in _corrections(spark, root) if not done]
    log = logged_updates(spark, root, schema).where(F.col(POSITION[0]) <= upto)
    fold_updates(spark, path, log, as_of, block_rows)
    fs, _ = entries(spark, root)
    for folder in known:
        fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, _FOLDED))
    if upto >= 0:
        release(spark, root, upto)

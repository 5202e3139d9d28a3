"""A stream of JSON lines with two sinks: messages are ingested, and lines that can't be stored are kept and counted.

Every line that isn't blank is either landed, or a repeat of a known message, or rejected: because it is no JSON, or
because it names no msg_id. The counts of each micro-batch add up to the lines read.
"""

from pyspark.sql import functions as F

from chatlens.session import materialise, passing_copies
from chatlens.sources.tables import BROKEN, messages_of, parsed_lines
from chatlens.streaming.batches import BATCH, read_batches, start, write_batch
from chatlens.streaming.ingest import LANDED, know_stored, land_batch

NO_JSON, NO_KEY = "no JSON", "no msg_id"
_REJECTS = "line string, reason string"
_COUNTS = "received long, landed long, repeated long, rejected long"


def land_lines(lines, batch_id, root, writer="stream"):
    """Land a batch of lines (again)."""
    spark = lines.sparkSession
    with passing_copies(spark):
        lines = materialise(lines.select("value").where("trim(value) <> ''"), "lines")
        parsed = materialise(parsed_lines(lines), "parsed")
        messages = messages_of(parsed)
        land_batch(messages, batch_id, root, writer)
        broken = parsed.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"), F.lit(NO_JSON).alias("reason"))
        spelled = F.to_json(F.struct(*[c for c in parsed.columns if c != BROKEN]))
        unnamed = parsed.where(F.isnull(BROKEN) & F.isnull("msg_id")).select(spelled.alias("line"), F.lit(NO_KEY).alias("reason"))
        rejects = materialise(broken.unionByName(unnamed), "rejects")
        write_batch(rejects, batch_id, f"{root}/rejects/{writer}")
        landed = read_batches(spark, f"{root}/landed/{writer}", LANDED, after=batch_id - 1).count()
        received, rejected = lines.count(), rejects.count()
        counts = [(received, landed, received - landed - rejected, rejected)]
        write_batch(spark.createDataFrame(counts, _COUNTS), batch_id, f"{root}/counts/{writer}")


def stream_ingest_lines(lines, stored, root, checkpoint, writer="stream", **options):
    """Ingest a stream of lines (`sources.tables.stream_lines`) into the store at root."""
    know_stored(stored, root)
    return start(lines, lambda batch, n: land_lines(batch, n, root, writer), checkpoint, **options)


def rejected_messages(spark, root, writer="stream"):
    """The rejected lines (of those without a key, the fields that were read) with their reason and batch."""
    return read_batches(spark, f"{root}/rejects/{writer}", spark.createDataFrame([], _REJECTS).schema)


def line_counts(spark, root, writer="stream"):
    """Lines received, and what became of them, over all micro-batches."""
    rows = read_batches(spark, f"{root}/counts/{writer}", spark.createDataFrame([], _COUNTS).schema).drop(BATCH)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])

"""Live panels: summaries of messages that are kept as state and merged micro-batch by micro-batch.

A summary turns the messages of a batch into a bounded number of rows (counters per label, per minute, the newest n
of each facet), rows of several batches into rows of the same kind, and these into the panel. Each micro-batch
writes its own rows into a log whose segments are merged level by level (streaming.batches); a panel is computed from the few
segments there are. No message is read twice, nothing is ever evicted, and a replayed batch replaces its own rows.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.operators.facets import latest_per_facet, newest
from chatlens.operators.filters import visible_messages
from chatlens.operators.timeline import merged_minutes, minute_counters, rolled_up
from chatlens.plans.dashboard import label_counters, merged_counters, overview_of
from chatlens.schema import FACET_SIZE
from chatlens.session import materialise, passing_copies
from chatlens.streaming.batches import BATCH, read_batches, start, write_batch


class Summary(NamedTuple):
    """How messages become rows, rows of several batches become fewer, and rows become the panel."""

    rows: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    panel: Callable[[DataFrame], DataFrame]

    def schema(self, messages):
        """Of the rows, for messages of a schema."""
        spark = messages.sparkSession
        return self.rows(spark.createDataFrame([], messages.schema)).schema


def overview():
    """All count panels of the dashboard, as `dashboard_overview`."""
    return Summary(label_counters, merged_counters, lambda rows: overview_of(merged_counters(rows)))


def adaptive_timeline(by=()):
    """As `stance_timeline_adaptive` over the visible messages: minutes are kept, the width follows the span."""
    return Summary(
        lambda messages: minute_counters(visible_messages(messages), by),
        lambda rows: merged_minutes(rows, by),
        lambda rows: rolled_up(merged_minutes(rows, by), by))


def latest_messages(n=FACET_SIZE, columns=None):
    """As `latest_per_facet` over the visible messages: at most n rows a facet are kept. Of a batch only what its counters
    per hour leave over is sorted."""
    def top(rows):
        return newest(rows, ["section", "label"], n)

    return Summary(
        lambda messages: latest_per_facet(visible_messages(messages), n, columns=columns).drop("rank"),
        lambda rows: top(rows).drop("rank"), top)


def land_panels(messages, batch_id, root, summaries):
    """Write the summaries' rows of a batch (again), from one copy of its messages."""
    with passing_copies(messages.sparkSession):
        messages = materialise(messages, "batch")
        for name, summary in summaries.items():
            def merge(rows, merged=summary.merge):
                return merged(rows.drop(BATCH)).withColumn(BATCH, F.lit(batch_id).cast("long"))

            write_batch(summary.rows(messages), batch_id, f"{root}/{name}", merge)


def stream_panels(messages, root, checkpoint, summaries, **options):
    """Keep the summaries (by name) of a stream of messages."""
    return start(messages, lambda batch, n: land_panels(batch, n, root, summaries), checkpoint, **options)


def live_panel(messages, root, name, summary):
    """A panel as of the last micro-batch; `messages`, the stream, tells the schema."""
    rows = read_batches(messages.sparkSession, f"{root}/{name}", summary.schema(messages)).drop(BATCH)
    return summary.panel(rows)

"""Stored names to display names and back."""

from pyspark.sql import functions as F

from chatlens.operators.filters import flags_as_boolean
from chatlens.schema import DISPLAY_NAMES, EDITABLE_NAMES, FLAGS, HIDDEN_NAMES


def display_messages(messages):
    """Display names and plain booleans; columns without a display name pass through."""
    return flags_as_boolean(messages, [*FLAGS, "enriched"]).withColumnsRenamed(DISPLAY_NAMES)


def editor_messages(messages):
    """What a reviewer sees: the display frame without platform ids."""
    return display_messages(messages).drop(*HIDDEN_NAMES)


def stored_labels(display):
    """Stored names of the editable columns; everything else is left out."""
    return display.select([F.col(f"`{shown}`").alias(name) for shown, name in EDITABLE_NAMES.items()])


def with_legacy_stance(messages):
    """Old tables carry `mishap` in place of `societal_impact`."""
    if "mishap" not in messages.columns:
        return messages
    if "societal_impact" not in messages.columns:
        return messages.withColumnRenamed("mishap", "societal_impact")
    return messages.withColumn("societal_impact", F.coalesce("societal_impact", "mishap")).drop("mishap")

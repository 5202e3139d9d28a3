"""Readers for messages, registry and streams: Parquet and JSON lines."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.time import lenient_timestamp
from chatlens.schema import LEGACY_COLUMNS, MESSAGES, REGISTRY


BROKEN = "_broken"


def _times_as_text(schema):
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
        for f in schema.fields
    ])


def _parse_times(df, schema):
    times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({name: lenient_timestamp(name) for name in times})


def read_messages(spark, path, fmt="parquet", schema=MESSAGES):
    """Messages with a declared schema; absent columns come back as NULL.

    JSON times are parsed leniently: a bad time gives NULL, not a lost row. Lines that are no JSON
    are left to `rejected_lines`.
    """
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    if fmt == "json":
        return messages_of(parsed_lines(spark.read.text(path), schema), schema)
    raise ValueError(f"unknown format {fmt!r}")


def parsed_lines(lines, schema=MESSAGES):
    """JSON lines (column value) with a column for the text of those that can't be read, blank ones left out; lines
    are texts first, as JSON files can't be queried for that column alone. Works on a batch or a stream."""
    broken = T.StructField(BROKEN, T.StringType())
    parsed = F.from_json(
        "value", T.StructType([*_times_as_text(schema).fields, broken]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return lines.where("trim(value) <> ''").select(parsed.alias("row")).select("row.*")


def messages_of(parsed, schema=MESSAGES):
    """The messages of parsed lines."""
    return _parse_times(parsed.where(F.isnull(BROKEN)).drop(BROKEN), schema)


def rejected_lines(spark, path, schema=MESSAGES):
    """The lines of JSON files that can't be read as a message."""
    parsed = parsed_lines(spark.read.text(path), schema)
    return parsed.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))


def read_registry(spark, path):
    return registry_listing(spark.read.schema(REGISTRY).parquet(path))


def registry_listing(registry):
    """The registry's three columns, taken by name."""
    return registry.select("url", "platform", "status")


def _stream_reader(spark, files_per_batch, glob):
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", glob) if glob else reader


def stream_messages(spark, path, fmt="parquet", schema=MESSAGES, files_per_batch=None, glob=None):
    """The live source: new files below path, picked up by every trigger.

    JSON lines that can't be read are left out; `streaming.lines` keeps and counts them.
    """
    reader = _stream_reader(spark, files_per_batch, glob)
    if fmt == "parquet":
        return reader.schema(schema).parquet(path)
    if fmt == "json":
        return messages_of(parsed_lines(reader.text(path), schema), schema)
    raise ValueError(f"unknown format {fmt!r}")


def stream_lines(spark, path, files_per_batch=None, glob=None):
    """New text files below path as lines (column value)."""
    return _stream_reader(spark, files_per_batch, glob).text(path)


def legacy_frame(rows):
    """Sixteen positional columns of the older store, under their display names."""
    return rows.toDF(*LEGACY_COLUMNS).withColumns({
        flag: F.coalesce(F.col(flag), F.lit(False)) for flag in ["Troll", "Toxic", "Enriched"]
    })

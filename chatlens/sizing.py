"""Broadcast only what has been measured."""

from functools import reduce
from operator import add

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.session import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
_FIXED_WIDTH = 16


def _width(column, kind):
    fixed = F.lit(_FIXED_WIDTH)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + fixed
    if isinstance(kind, T.StructType):
        return reduce(add, [_width(column[f.name], f.dataType) for f in kind.fields], fixed)
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(column, F.lit(0), lambda n, x: n + _width(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + fixed
    return fixed


def total_width(schema):
    """Width of all rows: text by its length, arrays by their size, plus a fixed width per column."""
    widths = [_width(F.col(f.name), f.dataType) for f in schema.fields]
    return F.coalesce(F.sum(reduce(add, widths).cast("long")), F.lit(0)).alias("bytes")


def _fits(width, broadcast_bytes):
    return width <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)


def is_small(df, broadcast_bytes=None):
    """Whether df, measured by one distributed sum, fits a broadcast."""
    return _fits(df.agg(total_width(df.schema)).first()["bytes"], broadcast_bytes)


def copy_with_width(df):
    """df written to the shared folder, and its width.

    df is computed once: its width is summed up while it is written.
    """
    seen = Observation()
    copy = materialise(df.observe(seen, total_width(df.schema)), "list")
    return copy, seen.get["bytes"]


def measured_copy(df, broadcast_bytes=None):
    """df written to the shared folder, and whether it fits a broadcast."""
    copy, width = copy_with_width(df)
    return copy, _fits(width, broadcast_bytes)


def broadcast_if_small(df, broadcast_bytes=None):
    """A copy of df with a broadcast hint if it fits, else for a shuffle join."""
    copy, small = measured_copy(df, broadcast_bytes)
    return F.broadcast(copy) if small else copy

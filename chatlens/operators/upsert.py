"""Keyed upserts: state and changes in, new state out."""

from pyspark.sql import functions as F

from chatlens.functions.time import moment
from chatlens.schema import FLAGS, LABELS, POSITION
from chatlens.sizing import measured_copy


def last_wins(changes, key, columns, order):
    """One row per key: the values of the change that comes last in `order`.

    Aggregates before it shuffles, so a key with very many changes stays cheap.
    """
    return changes.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_new")
    )


def _overwrite(state_fields, columns, stale):
    """Matched rows take every changed column, explicit NULLs included, unless the change is stale."""
    hit = F.col("_new").isNotNull()
    if stale is not None:
        hit = hit & ~F.coalesce(stale, F.lit(False))
    return [
        F.when(hit, F.col(f"_new.{name}").cast(kind)).otherwise(F.col(name)).alias(name)
        if name in columns else F.col(name)
        for name, kind in state_fields
    ]


def keyed_upsert(state, changes, key, insert_missing=True, small=False, stale=None):
    """Overwrite matching rows of state and add the unmatched changes.

    `stale`, an expression over a row and its `_new`, keeps a matched row.

    changes: one row per key, its values in the struct `_new`. With `small` the changes are
    broadcast and the state is not shuffled: unmatched keys then come from a second scan that
    reads only the key column. Otherwise one full outer join on the key.
    """
    columns = changes.schema["_new"].dataType.names
    state = state.withColumns({
        f.name: F.lit(None).cast(f.dataType)
        for f in changes.schema["_new"].dataType.fields if f.name not in state.columns
    })
    fields = [(f.name, f.dataType) for f in state.schema.fields]
    if not small:
        joined = state.join(changes, key, "full_outer" if insert_missing else "left")
        return joined.select(_overwrite(fields, columns, stale))
    joined = state.join(F.broadcast(changes), key, "left")
    updated = joined.select(_overwrite(fields, columns, stale))
    if not insert_missing:
        return updated
    known = state.select(key).join(F.broadcast(changes.select(key)), key, "left_semi")
    added = changes.join(known.distinct(), key, "left_anti").select([
        F.col(name) if name == key
        else (F.col(f"_new.{name}") if name in columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in fields
    ])
    return updated.unionByName(added)


def _at(names, prefix=""):
    return F.struct(*[F.col(f"{prefix}{n}").cast("long").alias(n) for n in names])


def enrichment_upsert(messages, updates, as_of=None, order=("seq",), insert_missing=True, broadcast_bytes=None):
    """Write labels back by message id.

    The last update of an id wins, an explicit NULL overwrites, unknown ids become partial
    rows, and matched rows are marked labelled. `as_of` (a time) stamps dt_enriched; without it the
    updates' own dt_enriched does, if they have one, else the stamp is left alone.

    Where both sides have a position in the label log (POSITION), it is kept with the row, and an update that
    is not later than the row's is ignored: writes may then come late, again, and in any order.

    The updates are collapsed to one row per id, written and measured once.
    """
    fixed = {"enriched": F.lit(True)}
    if as_of is not None:
        fixed["dt_enriched"] = moment(as_of)
    placed = set(POSITION) <= {*updates.columns} & {*messages.columns}
    values = [name for name in [*LABELS, "dt_enriched"] if name in updates.columns and name not in fixed]
    values += POSITION if placed else []
    stale = _at(POSITION) >= _at(POSITION, "_new.") if placed else None
    collapsed = last_wins(updates.withColumns(fixed), "id", [*values, *fixed], order)
    changes, small = measured_copy(collapsed, broadcast_bytes)
    return keyed_upsert(messages, changes, "id", insert_missing, small, stale)


def enrichment_update_only(messages, updates, order=("seq",), broadcast_bytes=None):
    """As enrichment_upsert, for known ids only and without a stamp."""
    return enrichment_upsert(messages, updates, None, order, insert_missing=False, broadcast_bytes=broadcast_bytes)


def edit_diff(original, edited, key="id", columns=None):
    """Edited rows that differ from the original in any editable column.

    NULL equals NULL, and a missing flag equals false, as both are shown unticked.
    """
    columns = [c for c in (columns or LABELS) if c in original.columns and c in edited.columns]
    shown = [F.coalesce(c, F.lit(False)).alias(c) if c in FLAGS else F.col(c) for c in columns]
    before = original.select(key, F.struct(*shown).alias("_before"))
    after = edited.select(key, *columns)
    same = F.struct(*shown).eqNullSafe(F.col("_before"))
    return after.join(before, key).where(~same).select(key, *columns)

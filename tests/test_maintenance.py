from datetime import datetime

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import ids, messages, registry, urls

from chatlens.operators import ingest, projections, quality, upsert
from chatlens.operators import registry as reg
from chatlens.operators.projections import editor_messages, stored_labels
from chatlens.plans import layout
from chatlens.plans.runs import correct_labels
from chatlens.schema import LABEL_UPDATES, MESSAGES, REGISTRY
from chatlens.sources.tables import read_messages, read_registry

AT = "2024-02-01 00:00:00"
BOTH_JOINS = pytest.mark.parametrize("broadcast_bytes", [0, None], ids=["shuffle", "broadcast"])


def updates(spark, *rows):
    names = LABEL_UPDATES.names
    base = {"sg": "Favor", "lang": "MS", "seq": 1}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], LABEL_UPDATES)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


@BOTH_JOINS
def test_upsert(spark, broadcast_bytes):
    df = messages(spark, {"enriched": False, "senti": "Pos"}, {"senti": "Pos", "delete": True}, {"senti": "Pos"})
    batch = updates(
        spark, {"id": 1, "sg": "Against", "seq": 2, "senti": None}, {"id": 1, "sg": "Neutral", "seq": 1, "senti": "Neg"},
        {"id": 2, "senti": "Neg"}, {"id": 9})
    state = by_id(upsert.enrichment_upsert(df, batch, AT, broadcast_bytes=broadcast_bytes))
    assert set(state) == {1, 2, 3, 9}
    assert (state[1]["sg"], state[1]["senti"], state[1]["enriched"]) == ("Against", None, True)
    assert state[1]["dt_enriched"] == datetime(2024, 2, 1) and state[1]["message"] == "long enough"
    assert (state[2]["senti"], state[2]["delete"]) == ("Neg", True)
    assert (state[3]["senti"], state[3]["dt_enriched"]) == ("Pos", None)
    assert (state[9]["message"], state[9]["enriched"], state[9]["sg"]) == (None, True, "Favor")


@BOTH_JOINS
def test_update_only_ignores_unknown_ids_and_leaves_no_stamp(spark, broadcast_bytes):
    df = messages(spark, {"enriched": False}, {})
    out = upsert.enrichment_update_only(df, updates(spark, {"id": 1}, {"id": 9}), broadcast_bytes=broadcast_bytes)
    state = by_id(out)
    assert set(state) == {1, 2} and state[1]["enriched"] and state[1]["dt_enriched"] is None


@BOTH_JOINS
def test_upsert_twice_is_upsert_once(spark, tiny, broadcast_bytes):
    from chatlens.sources import derived
    live, feed = derived.live(spark, tiny), derived.label_updates(spark, tiny)

    def apply(state):
        return upsert.enrichment_upsert(state, feed, AT, derived.UPDATE_ORDER, broadcast_bytes=broadcast_bytes)

    once = apply(live)
    assert rows_of_spark(apply(once)) == rows_of_spark(once)


@BOTH_JOINS
def test_empty_batch_changes_nothing(spark, broadcast_bytes):
    df = messages(spark, {}, {})
    out = upsert.enrichment_upsert(df, updates(spark), AT, broadcast_bytes=broadcast_bytes)
    assert rows_of_spark(out) == rows_of_spark(df)


def test_edit_diff(spark):
    df = messages(spark, {"sg": "Favor"}, {"troll": None}, {"troll": None}, {})
    edited = df.withColumns({
        "sg": F.expr("CASE WHEN id = 1 THEN 'NA' ELSE sg END"), "troll": F.expr("CASE WHEN id = 3 THEN true ELSE troll END"),
        "message": F.lit("not editable"),
    })
    assert ids(upsert.edit_diff(df, edited)) == [1, 3]
    shown = projections.stored_labels(projections.editor_messages(df))
    assert upsert.edit_diff(df, shown).count() == 0  # a missing flag is shown unticked, which is no edit


@BOTH_JOINS
def test_registry(spark, broadcast_bytes):
    state = registry(spark, ("u?v=1", "YouTube", "stopped"), ("u?v=2", "Other", "start"))
    added = reg.registry_upsert(state, urls(spark, "u?v=1", "u?v=3", "u?v=3"), broadcast_bytes=broadcast_bytes)
    assert sorted(map(tuple, added.collect())) == [
        ("u?v=1", "YouTube", "start"), ("u?v=2", "Other", "start"), ("u?v=3", "YouTube", "start")]
    assert tuple(reg.registry_upsert_counts(state, urls(spark, "u?v=1", "u?v=3", "u?v=3")).first()) == (1, 1)
    stopped = reg.registry_set_status(state, urls(spark, "u?v=2", "new"), "stopped", broadcast_bytes)
    assert sorted(r["status"] for r in stopped.collect()) == ["stopped", "stopped"]
    left = reg.registry_delete(state, urls(spark, "u?v=2", None), broadcast_bytes)
    assert [r["url"] for r in left.collect()] == ["u?v=1"]
    with pytest.raises(ValueError):
        reg.registry_set_status(state, urls(spark, "u?v=2"), "paused")


@BOTH_JOINS
def test_soft_delete(spark, broadcast_bytes):
    df = messages(spark, {"vid_id": "1", "delete": False}, {"vid_id": "1", "delete": True}, {"vid_id": "2"},
                  {"vid_id": None}, {"vid_id": "2", "delete": True})
    listed = urls(spark, "u?v=1", "again?v=1", "nokey")
    marks = {r["id"]: r["delete"] for r in reg.soft_delete(df, listed, broadcast_bytes).collect()}
    assert marks == {1: True, 2: True, 3: None, 4: None, 5: True}
    assert tuple(reg.soft_delete_counts(df, listed, broadcast_bytes).first()) == (2, 1)


def incoming(spark, *rows):
    schema = "vid_id string, author string, author_id string, dt_stamp timestamp_ntz, msg_id string, message string, arrival long"
    return spark.createDataFrame([("v", "a", "x", None, m, text, arrival) for m, text, arrival in rows], schema)


@BOTH_JOINS
def test_ingest(spark, broadcast_bytes):
    stored = messages(spark, {}, {"id": 40})
    batch = incoming(spark, ("m1", "again", 0), ("b", "second", 9), ("b", "first", 3), ("a", "x", 7), ("c", "y", 1))
    added = ingest.ingest_new_messages(stored, batch, broadcast_bytes=broadcast_bytes)
    assert sorted((r["id"], r["msg_id"], r["message"]) for r in added.collect()) == [
        (41, "c", "y"), (42, "b", "first"), (43, "a", "x")]
    assert added.where("enriched").count() == 0
    state = stored.unionByName(added, allowMissingColumns=True)
    assert ingest.ingest_new_messages(state, batch, broadcast_bytes=broadcast_bytes).count() == 0
    assert tuple(ingest.ingest_counts(batch, added).first()) == (5, 3, 2, 0)
    nameless = incoming(spark, (None, "one", 1), (None, "two", 2), ("d", "z", 3))
    assert ingest.ingest_rejects(nameless).count() == 2
    some = ingest.ingest_new_messages(stored, nameless, broadcast_bytes=broadcast_bytes)
    assert tuple(ingest.ingest_counts(nameless, some).first()) == (3, 1, 0, 2)
    assert ingest.ingest_new_messages(stored.where("false"), batch).agg(F.min("id")).first()[0] == 1


def test_ids_are_dense_in_order_and_fixed(spark):
    rows = spark.range(5000).selectExpr("id AS key", "hash(id) % 7 AS hot").repartition(9)
    numbered = ingest.sequence_ids(rows, ["hot", "key"], start=10, name="n")
    got = [(r["n"], r["hot"], r["key"]) for r in numbered.orderBy("n").collect()]
    assert [g[0] for g in got] == list(range(11, 5011))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert rows_of_spark(numbered) == rows_of_spark(numbered)
    assert ingest.sequence_ids(rows.where("false"), ["key"]).count() == 0


def test_uniqueness(spark):
    df = messages(spark, {"msg_id": "s"}, {"msg_id": "s"}, {"id": 2, "msg_id": "t"})
    assert {tuple(r) for r in quality.uniqueness_violations(df).collect()} == {("msg_id", "s", 2), ("id", "2", 2)}


def test_table_writes_touch_only_their_blocks(spark, tmp_path):
    path = str(tmp_path / "messages")
    layout.append_messages(messages(spark, *[{"vid_id": f"v{i // 10}"} for i in range(1, 31)]), path, block_rows=10)

    def files():
        return {p.parent.name: p.name for p in (tmp_path / "messages").glob("*/*.parquet")}

    before = files()
    layout.apply_label_updates(spark, path, updates(spark, {"id": 11}, {"id": 35}), AT, block_rows=10)
    table = layout.read_table(spark, path)
    assert table.count() == 31 and table.where("lang = 'MS'").count() == 2
    after = files()
    assert {b for b in after if before.get(b) != after[b]} == {"id_block=1", "id_block=3"}
    layout.apply_soft_delete(spark, path, urls(spark, "u?v=v0"), block_rows=10)
    table = layout.read_table(spark, path)
    assert ids(table.where("delete")) == list(range(1, 10)) and table.count() == 31
    assert files()["id_block=1"] == after["id_block=1"]


def test_correction_of_labels(spark, tmp_path):
    path = str(tmp_path / "messages")
    layout.append_messages(messages(spark, {}, {}, {}), path)
    original = stored_labels(editor_messages(layout.read_table(spark, path)))
    edited = original.withColumn("sg", F.expr("CASE WHEN id = 2 THEN 'Against' ELSE sg END"))
    correct_labels(spark, path, original, edited, AT)
    table = layout.read_table(spark, path)
    assert ids(table.where("sg = 'Against' AND dt_enriched IS NOT NULL")) == [2] and table.count() == 3


def test_small_table_can_replace_itself(spark, tmp_path):
    path = str(tmp_path / "registry")
    registry(spark, ("u1", "YouTube", "start")).write.parquet(path)
    layout.replace_table(reg.registry_upsert(read_registry(spark, path), urls(spark, "u2")), path)
    assert read_registry(spark, path).count() == 2
    with pytest.raises(ValueError):
        layout.empty_table(spark, path, REGISTRY, confirm="yes")
    layout.empty_table(spark, path, REGISTRY, confirm=path)
    assert read_registry(spark, path).count() == 0


def test_json_times_are_parsed_leniently(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"id": 1, "dt_stamp": "2024-03-01 12:00:00.5", "message": "hello there"}\n'
        '{"id": 2, "dt_stamp": "soon", "troll": true}\n{"id": 3, "dt_stamp": "2024-03-01T12:00:00"}\n')
    rows = by_id(read_messages(spark, str(tmp_path / "in"), "json"))
    assert rows[1]["dt_stamp"] == datetime(2024, 3, 1, 12, 0, 0, 500000)
    assert rows[2]["dt_stamp"] is None and rows[2]["troll"] and rows[2]["delete"] is None
    assert rows[3]["dt_stamp"] == datetime(2024, 3, 1, 12)
    with pytest.raises(ValueError):
        read_messages(spark, "x", "csv")


def test_parquet_without_later_columns(spark, tmp_path):
    path = str(tmp_path / "old")
    messages(spark, {}).drop("delete", "dt_enriched").write.parquet(path)
    assert read_messages(spark, path).schema == MESSAGES

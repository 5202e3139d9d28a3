import random
from datetime import timedelta

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import NOON, messages

from chatlens.operators import timeline, upsert
from chatlens.operators.filters import visible_messages
from chatlens.plans import layout
from chatlens.schema import LABEL_UPDATES, MESSAGES
from chatlens.session import materialise
from chatlens.sources import derived
from chatlens.sources.tables import stream_messages
from chatlens.streaming import enrichment, ingest
from chatlens.streaming import timeline as stream_time

AT = "2024-02-01 00:00:00"


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def add_file(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def dirs(tmp_path, *names):
    return [str(tmp_path / n) for n in names]


def test_ingest_over_restarts(spark, tmp_path):
    source, root, checkpoint = dirs(tmp_path, "in", "out", "check")
    stored = messages(spark, {"msg_id": "old"})

    def consume():
        stream = stream_messages(spark, source, schema=MESSAGES, files_per_batch=1)
        run(ingest.stream_ingest(stream, stored, root, checkpoint, available_now=True))
        return ingest.landed_messages(spark, root)

    late = NOON - timedelta(days=400)
    add_file(messages(spark, {"msg_id": "old"}, {"msg_id": "a"}, {"msg_id": "a"}), source)
    add_file(messages(spark, {"msg_id": "a"}, {"msg_id": "b", "dt_stamp": None}, {"msg_id": "c", "dt_stamp": late}), source)
    first = consume()
    assert sorted(r["msg_id"] for r in first.collect()) == ["a", "b", "c"]
    add_file(messages(spark, {"msg_id": "c"}, {"msg_id": "d"}), source)
    second = consume()
    assert sorted(r["msg_id"] for r in second.collect()) == ["a", "b", "c", "d"]
    assert sorted(r["id"] for r in second.collect()) == [2, 3, 4, 5]


def test_timeline_equals_batch_over_several_batches(spark, tiny, tmp_path):
    source, root, checkpoint = dirs(tmp_path, "in", "out", "check")
    live = derived.live(spark, tiny)
    for part in range(3):  # each file spans the whole month: buckets change again and again
        add_file(live.where(f"id % 3 = {part}"), source)
    stream = visible_messages(stream_messages(spark, source, schema=live.schema, files_per_batch=1))
    run(stream_time.stream_stance_timeline(stream, root, checkpoint, available_now=True))
    streamed = stream_time.streamed_timeline(spark, root, stream_time.counted(stream).schema)
    assert rows_of_spark(streamed) == rows_of_spark(timeline.stance_timeline(visible_messages(live)))


def test_late_messages_count_unless_a_delay_is_set(spark, tmp_path):
    on_time = messages(spark, {"sg": "Favor", "dt_stamp": NOON})
    much_later = messages(spark, {"id": 2, "sg": "Favor", "dt_stamp": NOON + timedelta(hours=5)})
    late = messages(spark, {"id": 3, "sg": "Favor", "dt_stamp": NOON})
    for delay, expected in [(None, 3), ("1 hour", 2)]:
        name = delay or "none"
        source, root, checkpoint = dirs(tmp_path, f"in {name}", f"out {name}", f"check {name}")
        for df in (on_time, much_later, late):
            add_file(df, source)
            stream = stream_messages(spark, source, files_per_batch=1)
            run(stream_time.stream_stance_timeline(stream, root, checkpoint, delay=delay, available_now=True))
        counted = stream_time.counted(stream, delay=delay)
        line = stream_time.streamed_timeline(spark, root, counted.schema)
        assert line.where("stance = 'sg'").agg(F.sum("favor")).first()[0] == expected


def test_label_log_equals_one_batch(spark, tiny, tmp_path):
    source, root, checkpoint = dirs(tmp_path, "in", "out", "check")
    live, feed = derived.live(spark, tiny), derived.label_updates(spark, tiny)
    add_file(feed.where("seq <= 3"), source)
    add_file(feed.where("seq > 3"), source)
    stream = stream_messages(spark, source, schema=feed.schema, files_per_batch=1)
    run(enrichment.stream_label_updates(stream, root, checkpoint, derived.UPDATE_ORDER, available_now=True))
    log = enrichment.logged_updates(spark, root, feed.schema)
    order = derived.UPDATE_ORDER
    batch = upsert.enrichment_upsert(live, feed, AT, order)
    # the first file may hold later seq values than the second only if the files were read out of order
    if log.groupBy("label_batch").agg(F.max("seq").alias("s")).orderBy("label_batch").first()["s"] <= 3:
        assert rows_of_spark(enrichment.current_messages(live, log, AT)) == rows_of_spark(batch)
    assert log.count() == log.select("id", "label_batch").distinct().count()


def test_later_batch_wins_and_folds(spark, tmp_path):
    source, root, checkpoint, table = dirs(tmp_path, "in", "out", "check", "table")
    layout.append_messages(messages(spark, {}, {}), table)

    def updates(sg, seq):
        return spark.createDataFrame([(1, sg, None, None, None, "EN", "Pos", True, None, seq)], LABEL_UPDATES)

    for batch in (updates("Favor", 9), updates("Against", 1)):
        add_file(batch, source)
        stream = stream_messages(spark, source, schema=LABEL_UPDATES)
        run(enrichment.stream_label_updates(stream, root, checkpoint, available_now=True))
    log = enrichment.logged_updates(spark, root, LABEL_UPDATES)
    current = enrichment.current_messages(layout.read_table(spark, table), log, AT)
    assert {r["id"]: r["sg"] for r in current.collect()} == {1: "Against", 2: "NA"}
    enrichment.fold_log(spark, table, root, LABEL_UPDATES, AT)
    folded = layout.read_table(spark, table)
    assert {r["id"]: r["sg"] for r in folded.collect()} == {1: "Against", 2: "NA"}
    assert enrichment.logged_updates(spark, root, LABEL_UPDATES, after=1).count() == 0
    assert enrichment.logged_updates(spark, root, LABEL_UPDATES).count() == 0


def label_rows(spark, *rows):
    """(id, sg, seq) as label updates."""
    return spark.createDataFrame([(i, sg, None, None, None, "EN", "Pos", True, None, seq) for i, sg, seq in rows], LABEL_UPDATES)


@pytest.fixture
def logged(spark, tmp_path):
    """A table of three messages, its label log, and a function that logs one more batch."""
    source, root, checkpoint, table = dirs(tmp_path, "in", "out", "check", "table")
    layout.append_messages(messages(spark, {}, {}, {}), table, block_rows=2)

    def log(*rows):
        add_file(label_rows(spark, *rows), source)
        stream = stream_messages(spark, source, schema=LABEL_UPDATES)
        run(enrichment.stream_label_updates(stream, root, checkpoint, as_of=AT, available_now=True))

    return table, root, log


def test_what_is_logged_during_a_fold_is_not_lost(spark, logged):
    """The stamp of a fold may lie after the logging of updates that it has not seen."""
    table, root, log = logged
    log((1, "Favor", 1))
    seen = materialise(enrichment.logged_updates(spark, root, LABEL_UPDATES), "seen")
    log((1, "Against", 1))
    enrichment.fold_updates(spark, table, seen, "2030-01-01 00:00:00")
    enrichment.fold_log(spark, table, root, LABEL_UPDATES, "2024-01-01 00:00:00")
    assert layout.read_table(spark, table).where("id = 1").first()["sg"] == "Against"


@pytest.mark.parametrize("seed", range(3))
def test_folds_in_any_order_equal_one_ordered_batch(spark, logged, seed):
    """Batches, a correction in between, and repetitions, folded in random order and parts."""
    table, root, log = logged
    log((1, "Favor", 1), (2, "Favor", 1), (9, "Favor", 1))
    log((2, "Against", 5), (2, "Neutral", 9))
    log_rows = enrichment.logged_updates(spark, root, LABEL_UPDATES)
    shown = materialise(enrichment.current_messages(layout.read_table(spark, table), log_rows), "shown")
    edited = shown.withColumn("sg", F.when(F.col("id").isin(1, 2, 3), "NA").otherwise(F.col("sg")))
    edited = edited.withColumn("troll", F.when(F.col("id") == 3, True).otherwise(F.col("troll")))
    changed = upsert.edit_diff(shown, edited)
    for _ in range(2):
        enrichment.log_correction(spark, root, changed, "first pass", AT)
    log((2, "Favor", 1), (10, "Favor", 1))
    parts = materialise(enrichment.logged_updates(spark, root, LABEL_UPDATES, after=-1), "parts")
    assert parts.where("label_turn = 1").count() == 3
    places = [(b, t) for b, t in parts.select("label_batch", "label_turn").distinct().collect()] * 2
    random.Random(seed).shuffle(places)
    for b, t in places:
        enrichment.fold_updates(spark, table, parts.where(f"label_batch = {b} AND label_turn = {t}"))
    got = {r["id"]: (r["sg"], r["troll"], r["label_batch"], r["label_turn"], str(r["dt_enriched"]))
           for r in layout.read_table(spark, table).collect()}
    assert got == {1: ("NA", True, 1, 1, AT), 2: ("Favor", True, 2, 0, AT), 3: ("NA", True, 1, 1, AT),
                   9: ("Favor", True, 0, 0, AT), 10: ("Favor", True, 2, 0, AT)}
    before = rows_of_spark(layout.read_table(spark, table))
    enrichment.fold_log(spark, table, root, LABEL_UPDATES)
    assert rows_of_spark(layout.read_table(spark, table)) == before
    assert enrichment.logged_updates(spark, root, LABEL_UPDATES).count() == 0


def test_label_writes_carry_all_labels(spark, logged):
    _, root, _ = logged
    with pytest.raises(ValueError):
        enrichment.log_correction(spark, root, spark.createDataFrame([(1, "NA")], "id long, sg string"), "x")

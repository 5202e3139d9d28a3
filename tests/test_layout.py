"""The table on disk: block size, label log and corrections, soft delete."""

import glob
import os

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import messages, urls

from chatlens.operators import facets
from chatlens.plans import layout
from chatlens.plans.runs import correct_labels
from chatlens.schema import LABELS
from chatlens.session import materialise, shared_dir
from chatlens.streaming import enrichment
from chatlens.streaming.batches import write_batch


def table(spark, tmp_path, rows=6, block_rows=2):
    path = str(tmp_path / "table")
    layout.append_messages(messages(spark, *[{"sg": "Favor", "vid_id": str(i % 2)} for i in range(rows)]), path, block_rows)
    return path


def test_block_size_is_kept_with_the_table(spark, tmp_path):
    path = table(spark, tmp_path)
    updates = spark.createDataFrame([(3, "NA", 1)], "id long, sg string, seq long")
    layout.apply_label_updates(spark, path, updates, "2024-02-01 00:00:00")
    got = layout.read_table(spark, path)
    assert got.count() == 6 and got.where("id = 3").first()["sg"] == "NA"
    with pytest.raises(ValueError):
        layout.apply_label_updates(spark, path, updates, "2024-02-01 00:00:00", block_rows=100)
    with pytest.raises(ValueError):
        layout.append_messages(messages(spark, {"id": 9}), path, 100)


def test_a_repeated_delete_writes_nothing(spark, tmp_path):
    path = table(spark, tmp_path)
    layout.apply_soft_delete(spark, path, urls(spark, "u?v=1"))
    assert layout.read_table(spark, path).where("delete").count() == 3
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}
    layout.apply_soft_delete(spark, path, urls(spark, "u?v=1"))
    assert files == {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_an_untouched_correction_changes_nothing(spark, tmp_path):
    path = table(spark, tmp_path)
    shown = layout.read_table(spark, path)
    before = rows_of_spark(shown)
    correct_labels(spark, path, shown, shown.select("id", *LABELS), "2024-02-01 00:00:00")
    assert rows_of_spark(layout.read_table(spark, path)) == before


@pytest.mark.parametrize(("batch", "kept"), [(0, "NA"), (3, "Against")])
def test_a_later_correction_survives_the_label_log(spark, tmp_path, batch, kept):
    """By its place in the log, whatever the clocks say: the correction comes after batch 2."""
    path, root = table(spark, tmp_path), str(tmp_path / "log")
    write_batch(layout.read_table(spark, path).select("id", *LABELS, "dt_enriched").limit(0), 2, root)
    log = layout.read_table(spark, path).where("id = 1").select("id", *LABELS).withColumns({
        "sg": F.lit("Against"), "dt_enriched": F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"),
        "label_batch": F.lit(batch), "label_turn": F.lit(0)})
    log = materialise(log, "log")
    shown = layout.read_table(spark, path)
    edited = shown.select("id", *LABELS).withColumn("sg", F.expr("CASE WHEN id = 1 THEN 'NA' ELSE sg END"))
    correct_labels(spark, path, shown, edited, "2020-01-01 00:00:00", log=root, name="pass")
    current = enrichment.current_messages(layout.read_table(spark, path), log)
    assert current.where("id = 1").first()["sg"] == kept
    enrichment.fold_updates(spark, path, log, "2024-04-01 00:00:00")
    assert layout.read_table(spark, path).where("id = 1").first()["sg"] == kept


def test_local_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "local-cluster[2,1,1024]"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_zoned_times_do_not_depend_on_the_drivers_zone(spark, small, monkeypatch):
    import time

    from chatlens.operators import filters
    from chatlens.sources import derived

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        visible = filters.visible_messages(derived.live(spark, small))
        zoned = visible.withColumn("dt_stamp", F.col("dt_stamp").cast("timestamp"))
        for rows in (visible, zoned):
            assert facets.latest_per_facet(rows, 3).count() == 30
    finally:
        monkeypatch.undo()
        time.tzset()

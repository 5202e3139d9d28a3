"""Queries over many batches: parts by several tasks, a bounded number of folders, little that is sorted."""

from datetime import timedelta

from pyspark.sql import functions as F
from rows import NOON, messages

from chatlens import catalog_streams
from chatlens.operators import facets
from chatlens.streaming import panels


def test_a_part_is_written_by_several_tasks_and_read_as_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_streams, "scratch_path", lambda _, name: str(tmp_path / name))
    sizes = []

    def start(stream, checkpoint):
        land = lambda batch, n: sizes.append(batch.count())
        return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    catalog_streams._fed(spark, [spark.range(0, 100, 1, 4), spark.range(100, 140, 1, 4)], start)
    assert len(list((tmp_path / "source").glob("part-*"))) == 8
    assert sizes == [100, 40]


def test_a_table_has_a_bounded_number_of_folders(spark):
    assert catalog_streams._block_rows(spark.range(3_000_000)) == 30_000
    assert catalog_streams._block_rows(spark.range(100_000)) == catalog_streams.BLOCK


def test_only_the_newest_hours_of_a_batch_are_sorted(spark, monkeypatch):
    rows = [{"sg": "Favor", "dt_stamp": NOON - timedelta(hours=h)} for h in range(200)]
    rows += [{"mil": "Against", "dt_stamp": NOON - timedelta(hours=500)}, {"mil": "Against", "dt_stamp": None}]
    sorted_rows = []
    for module in (facets, panels):
        def spied(found, *args, newest=module.newest):
            sorted_rows.append(found.count())
            return newest(found, *args)
        monkeypatch.setattr(module, "newest", spied)
    kept = panels.latest_messages(5).rows(messages(spark, *rows))
    shown = {(r["section"], r["label"]): r["n"] for r in kept.groupBy("section", "label").agg(F.count("*").alias("n")).collect()}
    assert sorted(shown.values()) == [2, 5] and max(sorted_rows) == 7


def test_lines_of_many_files_come_in_as_few_batches(spark, small, tmp_path, monkeypatch):
    spark.read.parquet(f"{small}/events.parquet").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    asked = []

    class Ended:
        def awaitTermination(self):
            pass

    def stream_lines(_, source, files_per_batch):
        files = len([p for p in spark.read.text(source).inputFiles()])
        asked.append(-(-files // files_per_batch))

    monkeypatch.setattr(catalog_streams, "stream_lines", stream_lines)
    monkeypatch.setattr(catalog_streams.lines, "stream_ingest_lines", lambda *args, **options: Ended())
    catalog_streams._lines(spark, str(tmp_path))
    assert asked == [2]

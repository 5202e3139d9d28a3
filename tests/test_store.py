"""Ids for several writers, known keys, ingest and fold, refused repeats."""

import glob
import os

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import messages

from chatlens.operators.quality import uniqueness_violations
from chatlens.plans import keys, layout, ledger
from chatlens.plans.store import append_unique
from chatlens.schema import LABELS, SUPPLIED
from chatlens.streaming import batches, ingest


def batch(spark, *names):
    return messages(spark, *[{"msg_id": n} for n in names])


def test_interleaved_writers_never_share_an_id(spark, tmp_path):
    root = str(tmp_path / "ids")
    assert ledger.reserve_ids(spark, root, "a", 0, 10, at_least=5) == 5
    assert ledger.reserve_ids(spark, root, "b", 0, 3) == 15
    assert ledger.reserve_ids(spark, root, "a", 1, 2) == 18
    assert ledger.reserve_ids(spark, root, "b", 0, 3) == 15  # replayed
    assert ledger.reserve_ids(spark, root, "a", 1, 2) == 18
    with pytest.raises(ValueError):
        ledger.reserve_ids(spark, root, "a", 0, 10)
    assert ledger.next_id(spark, root) == 20


def test_the_slower_of_two_writers_tries_again(spark, tmp_path, monkeypatch):
    root, honest = str(tmp_path / "ids"), ledger._Folder.write
    ledger.reserve_ids(spark, root, "a", 0, 4)

    def late(self, number, entry):
        monkeypatch.setattr(ledger._Folder, "write", honest)
        assert ledger.reserve_ids(spark, root, "fast", 0, 100) == 5  # between reading and writing of the other
        return honest(self, number, entry)

    monkeypatch.setattr(ledger._Folder, "write", late)
    assert ledger.reserve_ids(spark, root, "slow", 0, 7) == 105
    assert ledger.next_id(spark, root) == 112 and not glob.glob(f"{root}/.draft-*")


def test_old_entries_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "_KEPT", 3)
    root = str(tmp_path / "ids")
    for n in range(10):
        ledger.reserve_ids(spark, root, "a", n, 1)
    assert len(glob.glob(f"{root}/entry-*")) <= 5 and ledger.next_id(spark, root) == 11


def test_keys_are_read_by_matching_bucket(spark, tmp_path):
    root = str(tmp_path / "keys")
    keys.write_keys(messages(spark, *[{"msg_id": f"k{i}"} for i in range(500)]), root, "w", 0)
    asked = batch(spark, "k7", "new")
    found = keys.stored_again(asked, root)
    assert [tuple(r) for r in found.collect()] == [("k7", 8)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(msg_id,k7)" in plan
    many = messages(spark, *[{"msg_id": f"k{i}"} for i in range(450, 600)])
    for bound in (None, 0):
        assert {r["msg_id"] for r in keys.stored_again(many, root, broadcast_bytes=bound).collect()} == {f"k{i}" for i in range(450, 500)}
    assert keys.stored_again(asked, root, "w", 0).count() == 0 and keys.stored_again(asked.limit(0), root).count() == 0


def spoil(folder):
    for name in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        with open(name, "wb") as f:
            f.write(b"no message file is opened again")


def test_a_batch_opens_no_message_file_of_earlier_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "FAN_IN", 100)
    root = str(tmp_path / "store")
    ingest.know_stored(messages(spark, {"id": 41, "msg_id": "old"}), root)
    ingest.land_batch(batch(spark, "a", "b", "a"), 0, root)
    ingest.land_batch(batch(spark, "b", "c", "old"), 1, root)
    assert sorted((r["msg_id"], r["id"]) for r in ingest.landed_messages(spark, root).collect()) == [("a", 42), ("b", 43), ("c", 44)]
    spoil(f"{root}/landed")
    for _ in range(2):  # and its replay
        ingest.land_batch(batch(spark, "a", "c", "old", "d", "e"), 2, root)
    kept = spark.read.schema(ingest.LANDED).parquet(f"{root}/landed/stream/0000000002-0000000002")
    assert sorted((r["msg_id"], r["id"]) for r in kept.collect()) == [("d", 45), ("e", 46)]


def test_two_streams_share_ids(spark, tmp_path):
    root = str(tmp_path / "store")
    ingest.land_batch(batch(spark, "a"), 0, root, "one")
    ingest.land_batch(batch(spark, "b", "c", "a"), 0, root, "two")
    ingest.land_batch(batch(spark, "d", "c"), 1, root, "one")
    got = [(r["msg_id"], r["id"]) for w in ("one", "two") for r in ingest.landed_messages(spark, root, w).collect()]
    assert sorted(got) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_fold_landed(spark, tmp_path):
    """Folds between batches, a repeated fold, and labels that come before their message."""
    root, path = str(tmp_path / "store"), str(tmp_path / "table")
    layout.append_messages(messages(spark, {"msg_id": "old"}), path, block_rows=3)
    ingest.know_stored(layout.read_table(spark, path), root)
    ingest.land_batch(batch(spark, "a", "b"), 0, root)
    labels = spark.createDataFrame([(3, "Favor", 1), (4, "Against", 1)], "id long, sg string, seq long")
    layout.apply_label_updates(spark, path, labels, "2024-02-01 00:00:00")
    ingest.fold_landed(spark, root, path)
    assert ingest.landed_messages(spark, root).count() == 0
    ingest.land_batch(batch(spark, "a", "c", "d", "e"), 1, root)
    rows = ingest.landed_messages(spark, root)
    assert rows.count() == 3
    layout.insert_messages(spark, path, rows)  # a fold that fails before it is recorded
    ingest.fold_landed(spark, root, path)
    ingest.fold_landed(spark, root, path)
    got = sorted((r["id"], r["msg_id"], r["enriched"], r["sg"]) for r in layout.read_table(spark, path).collect())
    assert got == [(1, "old", True, "NA"), (2, "a", False, None), (3, "b", True, "Favor"), (4, "c", True, "Against"),
                   (5, "d", False, None), (6, "e", False, None)]


def test_appended_twice_nothing_is_double(spark, tmp_path):
    root, path = str(tmp_path / "store"), str(tmp_path / "table")
    rows = messages(spark, {"msg_id": "a"}, {"msg_id": "b"}, {"msg_id": "c"})
    assert append_unique(rows, path, root).count() == 0
    before = rows_of_spark(layout.read_table(spark, path))
    refused = append_unique(rows, path, root)
    assert refused.select("reason").distinct().collect() == [("msg_id stored",)] and refused.count() == 3
    assert rows_of_spark(layout.read_table(spark, path)) == before
    more = messages(
        spark, {"id": 2, "msg_id": "x"}, {"id": 9, "msg_id": "y"}, {"id": 9, "msg_id": "z"}, {"id": 10, "msg_id": "y"},
        {"id": None, "msg_id": "n"}, {"id": 12, "msg_id": None}, {"id": 13, "msg_id": "c"})
    for _ in range(2):  # the second time as a repetition of the same batch
        got = append_unique(more, path, root, batch=2)
        assert sorted((str(r["id"]), str(r["msg_id"]), r["reason"]) for r in got.collect()) == [
            ("10", "y", "msg_id repeated"), ("12", "None", "no id or msg_id"), ("13", "c", "msg_id stored"),
            ("2", "x", "id stored"), ("9", "z", "id repeated"), ("None", "n", "no id or msg_id")]
    table = layout.read_table(spark, path)
    assert uniqueness_violations(table).count() == 0 and table.count() == 4
    ingest.land_batch(batch(spark, "y", "new"), 0, root)
    assert [(r["id"], r["msg_id"]) for r in ingest.landed_messages(spark, root).collect()] == [(10, "new")]


def test_a_message_keeps_its_labels_on_insert(spark, tmp_path):
    path = str(tmp_path / "table")
    layout.append_messages(messages(spark, {"sg": "Favor"}), path)
    layout.insert_messages(spark, path, messages(spark, {"message": "new text"}).select("id", *SUPPLIED))
    row = layout.read_table(spark, path).first()
    assert row["message"] == "new text" and row["sg"] == "Favor" and row["n_chars"] == 8
    assert set(LABELS) <= set(row.asDict()) and os.path.isdir(path)
    assert layout.read_table(spark, path).agg(F.count("*")).first()[0] == 1

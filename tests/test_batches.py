"""The log of micro-batches: merges, what is read, what goes, replays."""

import os

import pytest
from pyspark.sql import functions as F

from chatlens.streaming import batches


def grown(last, replay=()):
    """Segments after batches 0 .. last, without Spark; every batch in `replay` is done twice."""
    found = set()
    for n in range(last + 1):
        for _ in range(2 if n in replay else 1):
            found |= {(n, n), *batches.merges_due(n)}
            found -= set(batches.removable(found, n))
        yield n, sorted(found)


def test_a_thousand_batches_are_read_from_few_folders():
    for n, found in grown(1000, replay={7, 63, 511, 512}):
        chosen = batches.cover(found)
        assert [b for first, last in chosen for b in range(first, last + 1)] == list(range(n + 1))
        levels = 1 + sum(n + 1 >= batches.FAN_IN ** k for k in range(1, 5))
        assert len(chosen) <= levels * (batches.FAN_IN - 1)
        assert len(found) <= 2 * levels * batches.FAN_IN
        before = batches.cover([s for s in found if s[1] < n])  # what a replay of the last batch reads
        assert [b for first, last in before for b in range(first, last + 1)] == list(range(n))


def test_released_batches_go_but_the_last_stays():
    found = [(0, 7), (8, 8), (9, 9), (10, 10)]
    assert batches.removable(found, 10, released_at=9) == [(0, 7), (8, 8), (9, 9)]
    assert batches.removable(found, 9, released_at=9) == [(0, 7), (8, 8)]
    assert batches.cover(found, after=8) == [(9, 9), (10, 10)]


@pytest.mark.parametrize("merged", [False, True])
def test_rows_survive_merges_and_replays(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(batches, "FAN_IN", 3)
    monkeypatch.setattr(batches, "KEEP", 2)
    root = str(tmp_path / "log")

    def newest(rows):
        return batches.latest(rows, ["k"])

    for n in range(11):
        rows = spark.createDataFrame([(n % 4, n), (100 + n, n)], "k long, v long")
        for _ in range(2 if n in (2, 8) else 1):  # batch 8 ends two merges
            batches.write_batch(rows, n, root, newest if merged else None)
    read = batches.read_batches(spark, root, rows.schema)
    want = {(100 + n, n, n) for n in range(11)} | ({(n % 4, n, n) for n in range(7, 11)} if merged else {(n % 4, n, n) for n in range(11)})
    got = [tuple(r) for r in (newest(read) if merged else read).select("k", "v", "batch").collect()]
    assert sorted(got) == sorted(want)
    assert batches.segments(spark, root)[0] == (0, 8) and len(batches.cover(batches.segments(spark, root))) == 3
    assert {r["v"] for r in batches.read_batches(spark, root, rows.schema, after=9).collect()} == {10}
    assert batches.read_batches(spark, root, rows.schema, before=9).agg(F.max("batch")).first()[0] == 8
    batches.release(spark, root, 8)
    assert batches.released(spark, root) == 8
    batches.write_batch(rows, 11, root)
    assert not [d for d in os.listdir(root) if d.startswith("0000000000-")]


def test_an_empty_log(spark, tmp_path):
    assert batches.read_batches(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0
    assert batches.last_batch(spark, str(tmp_path / "none")) == -1

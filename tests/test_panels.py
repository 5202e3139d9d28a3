"""Live panels and late messages: equal to the batch results after every micro-batch."""

from datetime import timedelta

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import NOON, messages

from chatlens.operators import facets, timeline
from chatlens.operators.filters import visible_messages
from chatlens.plans.dashboard import dashboard_overview
from chatlens.sources import derived
from chatlens.streaming import batches, panels
from chatlens.streaming.late import LateTimeline


@pytest.fixture
def parts(spark, tiny):
    """`live` in five parts whose time span grows from minutes to a month."""
    live = derived.live(spark, tiny).withColumn("dt_stamp", F.expr(
        "CASE WHEN id <= 60 THEN timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10) "
        "WHEN id <= 120 THEN timestamp_ntz'2024-03-01 00:30:00' + make_dt_interval(0, 0, id % 20) "
        "WHEN id <= 180 THEN timestamp_ntz'2024-03-01 00:30:00' + make_dt_interval(0, 0, id % 80) ELSE dt_stamp END"))
    return [live.where(w) for w in ("id <= 60", "id > 60 AND id <= 120", "id > 120 AND id <= 180", "id > 180 AND id % 2 = 0",
                                    "id > 180 AND id % 2 = 1")]


def test_panels_equal_batch_after_every_batch(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(batches, "FAN_IN", 2)
    monkeypatch.setattr(batches, "KEEP", 1)
    root = str(tmp_path / "panels")
    kept = {"overview": panels.overview(), "timeline": panels.adaptive_timeline(),
            "by video": panels.adaptive_timeline(["vid_id"]), "latest": panels.latest_messages(7)}
    seen, widths = parts[0].limit(0), []
    for n, part in enumerate(parts):
        for _ in range(2 if n == 3 else 1):  # batch 3 ends two merges and is replayed
            panels.land_panels(part, n, root, kept)
        seen = seen.unionByName(part)
        visible = visible_messages(seen)
        want = {"overview": dashboard_overview(seen), "timeline": timeline.stance_timeline_adaptive(visible),
                "by video": timeline.stance_timeline_adaptive(visible, ["vid_id"]), "latest": facets.latest_per_facet(visible, 7)}
        for name, summary in kept.items():
            got = panels.live_panel(parts[0], root, name, summary)
            assert rows_of_spark(got) == rows_of_spark(want[name]), (n, name)
        widths.append(want["timeline"].first()["width"])
    assert widths == sorted(widths) and len(set(widths)) >= 3


def test_state_is_bounded(spark, tmp_path, parts):
    root = str(tmp_path / "panels")
    kept = {"overview": panels.overview(), "latest": panels.latest_messages(3)}
    panels.land_panels(parts[3], 0, root, kept)
    rows = {name: batches.read_batches(spark, f"{root}/{name}", s.schema(parts[0])).count() for name, s in kept.items()}
    assert rows["overview"] <= 2 * 5 * 6 and rows["latest"] <= 3 * len(facets.FACETS)


def test_late_messages_are_listed_and_repaired(spark, tmp_path):
    def at(i, minutes, **more):
        return {"id": i, "sg": "Favor", "dt_stamp": None if minutes is None else NOON + timedelta(minutes=minutes), **more}

    parts = [messages(spark, at(1, 0), at(2, 100)), messages(spark, at(3, 20), at(4, 30), at(5, None)),
             messages(spark, at(6, 300), at(7, 29)), messages(spark, at(8, 101), at(9, 250, sg="Against"), at(10, 1, sg="Neutral"))]
    line = LateTimeline(parts[0], str(tmp_path / "late"))
    for n, part in enumerate(parts):
        for _ in range(2):
            line.land(part, n)
    # batch 1 and 2: closed up to 12:40; batch 3: closed up to 16:00
    assert sorted((r["id"], r["batch"]) for r in line.late_messages().select("id", "batch").collect()) == [
        (3, 1), (7, 2), (8, 3), (10, 3)]
    assert line.late_counts().agg(F.sum("late")).first()[0] == 4
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert rows_of_spark(line.repaired()) == rows_of_spark(timeline.stance_timeline(everything))
    on_time = everything.where("id NOT IN (3, 7, 8, 10)")
    assert rows_of_spark(line.timeline()) == rows_of_spark(timeline.stance_timeline(on_time))

"""The physical plans say what the docs say."""

import contextlib
import io

from rows import messages, urls

from chatlens.operators import facets, filters, metrics, timeline, upsert
from chatlens.operators import registry as reg
from chatlens.plans import layout
from chatlens.plans.dashboard import dashboard_overview
from chatlens.sources import derived


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def table(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.append_messages(messages(spark, {}, {}, {}), path)
    return layout.read_table(spark, path)


def test_panels_read_no_text_and_push_the_length_rule(spark, tmp_path):
    visible = filters.visible_messages(table(spark, tmp_path))
    for panel in (metrics.flag_rates, metrics.stance_totals, timeline.stance_timeline, facets.facet_sufficiency):
        text = plan(panel(visible))
        assert "message:string" not in text and "GreaterThan(n_chars,5)" in text, panel


def test_panels_aggregate_before_the_shuffle(spark, tmp_path):
    live = table(spark, tmp_path)
    for df in (dashboard_overview(live), timeline.stance_timeline(filters.visible_messages(live))):
        text = plan(df)
        assert "partial_count" in text and text.count("Scan parquet") // 2 == 1


def test_facets_limit_before_the_shuffle_and_prune_the_scan(spark, small):
    text = plan(facets.latest_per_facet(filters.visible_messages(derived.live(spark, small))))
    assert text.count("WindowGroupLimit") // 2 == 4 and text.count("Scan parquet") // 2 == 1
    assert "GreaterThanOrEqual(ts" in text


def test_key_lists_are_broadcast_only_while_small(spark, tmp_path):
    live, listed = table(spark, tmp_path), urls(spark, "u?v=1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for broadcast_bytes, kind in [(None, "BroadcastHashJoin"), (0, "SortMergeJoin")]:
            assert kind in plan(filters.messages_for_videos(live, listed, broadcast_bytes))
            assert kind in plan(reg.soft_delete(live, listed, broadcast_bytes))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_label_batch_does_not_shuffle_the_state(spark, tmp_path):
    live = table(spark, tmp_path)
    updates = live.selectExpr("id", "'Favor' AS sg", "1 AS seq")
    text = plan(upsert.enrichment_update_only(live, updates))
    assert "BroadcastHashJoin LeftOuter" in text and "SortMergeJoin" not in text


def test_short_facets_leave_the_time_filter_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.append_messages(messages(spark, *[{"sg": "Favor", "senti": "Neg"}] * 5, {"mil": "Favor"}), path)
    text = plan(facets.latest_per_facet(filters.visible_messages(layout.read_table(spark, path)), 3))
    assert "GreaterThanOrEqual(dt_stamp" in text and "EqualTo(mil,Favor)" in text


def test_latest_by_video_ranks_before_it_reads_texts(spark, small):
    visible = filters.visible_messages(derived.live(spark, small))
    text = plan(facets.latest_per_facet(visible, by=["vid_id"]))
    assert "WindowGroupLimit" not in text and "BroadcastHashJoin" in text


def test_updates_and_messages_are_read_once(spark, small):
    live = derived.live(spark, small)
    updates = derived.label_updates(spark, small)
    assert "lineitem" not in plan(upsert.enrichment_upsert(live, updates, "2024-02-01 00:00:00", derived.UPDATE_ORDER))
    assert "events" not in plan(timeline.stance_timeline_adaptive(filters.visible_messages(live)))

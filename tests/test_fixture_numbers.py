"""Counts known in advance for sf0.01."""

from pyspark.sql import functions as F
from rows import urls

from chatlens.operators import facets, filters, ingest, metrics, timeline, upsert
from chatlens.operators import registry as reg
from chatlens.plans.dashboard import dashboard_overview
from chatlens.sources import derived


def _live(spark, small):
    return derived.live(spark, small)


def _visible(spark, small):
    return filters.visible_messages(_live(spark, small))


def test_counts(spark, small):
    row = metrics.corpus_counts(_live(spark, small)).first()
    assert (row["not_enriched"], row["enriched"]) == (1818, 6844)
    row = metrics.corpus_counts(derived.docmsg(spark, small)).first()
    assert (row["not_enriched"], row["enriched"]) == (600, 399)


def test_sentiments_and_flags(spark, small):
    visible = _visible(spark, small)
    found = {r["sentiment"]: r["n"] for r in metrics.sentiment_distribution(visible).collect()}
    assert found == {"Positive": 1668, "Neutral": 1684, "Negative": 1833}
    flags = {r["flag"]: r["text"] for r in metrics.flag_rates(visible).collect()}
    assert flags["troll"] == "802 of 6844 (11.7%)"
    assert flags["toxic"].startswith("1386 of 6844")


def test_languages_and_stances(spark, small):
    visible = _visible(spark, small)
    first = metrics.language_distribution(visible).first()
    assert (first["lang"], first["n"], first["pct"]) == ("EN", 2931, 42.8)
    totals = {r["stance"]: (r["favor"], r["neutral"], r["against"]) for r in metrics.stance_totals(visible).collect()}
    assert totals == {
        "sg": (1711, 1710, 1712), "mil": (1752, 1701, 1716),
        "rnr": (1757, 1664, 1754), "societal_impact": (1692, 1761, 1730),
    }


def test_timeline(spark, small):
    line = timeline.stance_timeline(_visible(spark, small))
    assert line.count() == 10656
    assert line.where("stance = 'sg'").count() == 2664
    peaks = {r["stance"]: r["peak"] for r in timeline.stance_peaks(_visible(spark, small)).collect()}
    assert peaks["sg"] == 3


def test_overview_agrees_with_the_panels(spark, small):
    rows = {(r["panel"], r["item"]): r for r in dashboard_overview(_live(spark, small)).collect()}
    assert rows["corpus", "enriched"]["n"] == 6844
    assert rows["flag", "troll"]["text"] == "802 of 6844 (11.7%)"
    assert rows["mil", "Against"]["n"] == 1716
    assert rows["language", "EN"]["pct"] == 42.8


def test_facets(spark, small):
    latest = facets.latest_per_facet(_visible(spark, small))
    assert latest.count() == 300


def test_known_label_batch(spark, small):
    live = _live(spark, small)
    first = live.where("id % 10 = 3").selectExpr(
        "id", "'NA' AS sg", "CASE WHEN id % 20 = 3 THEN NULL ELSE 'Favor' END AS senti", "true AS toxic", "1 AS seq")
    second = live.where("id % 40 = 3").selectExpr(
        "id", "'Favor' AS sg", "'Pos' AS senti", "false AS toxic", "2 AS seq")
    unknown = live.where("id % 500 = 7").selectExpr(
        "id + 1000000 AS id", "'Against' AS sg", "'Neg' AS senti", "true AS toxic", "1 AS seq")
    updates = first.unionByName(second).unionByName(unknown)
    assert updates.count() == 1270
    for broadcast_bytes in (0, None):
        state = upsert.enrichment_upsert(live, updates, broadcast_bytes=broadcast_bytes)
        assert state.count() == 10020
        assert state.where("id % 40 = 3 AND id < 1000000 AND NOT (sg = 'Favor' AND senti = 'Pos')").count() == 0
        assert state.where("id % 40 = 23 AND id < 1000000 AND senti IS NOT NULL").count() == 0


def test_known_deletes(spark, small):
    live, registry = _live(spark, small), derived.registry(spark, small)
    drop = urls(
        spark, "https://video.example/watch?v=v1", "https://video.example/watch?v=v2", "https://video.example/none")
    counts = reg.soft_delete_counts(live, drop).first()
    assert (counts["matched"], counts["modified"]) == (1083, 1015)
    assert filters.messages_for_videos(live, drop).count() == 806
    assert reg.registry_delete(registry, drop).count() == 18
    both = reg.delete_counts(registry, live, drop).first()
    assert (both["deleted_count"], both["modified_count"]) == (2, 1015)


def test_known_batch_of_new_messages(spark, small):
    live = _live(spark, small)
    stored = live.where("id % 4 = 0").withColumn("arrival", F.col("id"))
    new = live.where("id % 50 = 1").withColumns({"msg_id": F.expr("concat('x', id)"), "arrival": F.col("id")})
    later = live.where("id % 100 = 1").withColumns({
        "msg_id": F.expr("concat('x', id)"), "message": F.lit("later copy"), "arrival": F.expr("id + 5000000")})
    batch = stored.unionByName(new).unionByName(later)
    assert batch.count() == 2800
    for broadcast_bytes in (0, None):
        added = ingest.ingest_new_messages(live, batch, broadcast_bytes=broadcast_bytes)
        assert added.count() == 200
        assert added.where("message = 'later copy'").count() == 0
        assert sorted(r[0] for r in added.select("id").collect()) == list(range(10001, 10201))


def test_known_edits(spark, small):
    live = _live(spark, small)
    edited = live.withColumns({
        "sg": F.expr("CASE WHEN id % 100 = 1 THEN 'NA' ELSE sg END"),
        "troll": F.expr("CASE WHEN id % 100 <> 29 THEN troll END"),
    })
    assert upsert.edit_diff(live, edited).count() == 113  # a missing flag equals false

from rows import ids, messages, registry, urls

from chatlens.functions.text import video_key
from chatlens.operators import filters, projections


def test_length_counts_code_points(spark):
    df = messages(
        spark, {"message": "12345"}, {"message": "123456"}, {"message": "ab😀é56"}, {"message": "😀😀😀"},
        {"message": None}, {"message": ""})
    assert ids(filters.visible_messages(df)) == [2, 3]


def test_stored_length_replaces_the_text(spark):
    df = messages(spark, {"message": "12345"}, {"message": "123456"}).selectExpr("*", "length(message) AS n_chars")
    assert ids(filters.visible_messages(df.drop("message"))) == [2]


def test_missing_and_false_delete_are_visible(spark):
    df = messages(spark, {"delete": None}, {"delete": False}, {"delete": True})
    assert ids(filters.visible_messages(df)) == [1, 2]


def test_unknown_enriched_is_on_neither_side(spark):
    df = messages(spark, {"enriched": True}, {"enriched": False, "delete": True}, {"enriched": None})
    assert ids(filters.visible_messages(df)) == [1]
    assert ids(filters.backlog_messages(df)) == [2]


def test_backlog_limit(spark):
    df = messages(spark, *[{"enriched": False}] * 5)
    assert ids(filters.backlog_limit(df, 2)) == [1, 2]
    assert ids(filters.backlog_limit(df, 0)) == []


def test_video_key(spark):
    given = urls(spark, "https://h/none", "https://h/w?v=abc", "https://h/w?page=2&ref=x", "https://h/w?v=", None)
    keys = [r[0] for r in given.select(video_key("url")).collect()]
    assert keys == [None, "abc", "2&ref", "", None]


def test_messages_for_videos_keeps_deleted_and_matches_once(spark):
    df = messages(
        spark, {"vid_id": "a", "delete": True}, {"vid_id": "a"}, {"vid_id": "b"}, {"vid_id": "a", "enriched": False},
        {"vid_id": None})
    listed = urls(spark, "u?v=a", "other?v=a", "nokey")
    for broadcast_bytes in (0, None):
        assert ids(filters.messages_for_videos(df, listed, broadcast_bytes)) == [1, 2]


def test_registry_views(spark):
    reg = registry(spark, ("u1", "YouTube", "start"), ("u2", "YouTube", "stopped"))
    assert [r[0] for r in filters.active_urls(reg).collect()] == ["u1"]
    assert [r[0] for r in filters.registry_status(reg, "u2").collect()] == ["stopped"]
    assert filters.registry_status(reg, "u3").collect() == []
    assert filters.active_urls(reg.where("false")).collect() == []


def test_domain_violations(spark):
    df = messages(
        spark, {"senti": "NA"}, {"lang": "English"}, {"sg": None}, {"mil": "NA"}, {"rnr": "favor"})
    found = {(r["id"], r["field"], r["value"]) for r in filters.domain_violations(df).collect()}
    assert found == {(1, "senti", "NA"), (2, "lang", "English"), (3, "sg", None), (5, "rnr", "favor")}


def test_display_round_trip(spark):
    df = messages(spark, {"troll": None, "toxic": True, "sg": "Favor"})
    shown = projections.editor_messages(df)
    assert "Msg Id" not in shown.columns and {"Create DateTime", "delete", "dt_enriched"} <= set(shown.columns)
    row = projections.stored_labels(shown).first()
    assert (row["id"], row["troll"], row["toxic"], row["sg"]) == (1, False, True, "Favor")


def test_legacy_stance(spark):
    df = messages(spark, {"societal_impact": None}, {"societal_impact": "Favor"})
    old = df.selectExpr("*", "'Against' AS mishap")
    values = [r[0] for r in projections.with_legacy_stance(old).orderBy("id").select("societal_impact").collect()]
    assert values == ["Against", "Favor"]
    only_old = old.drop("societal_impact")
    assert {r[0] for r in projections.with_legacy_stance(only_old).select("societal_impact").collect()} == {"Against"}

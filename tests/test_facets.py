import random
from datetime import datetime, timedelta

import pytest
from rows import NOON, messages

from chatlens.operators import facets, summaries
from chatlens.plans.runs import append_summaries, summary_run
from chatlens.schema import FACETS, SECTION_COLUMNS

AT = "2024-02-01 00:00:00"


def _random_messages(spark, count, seed, hot_hour=False):
    rng = random.Random(seed)
    stances = ["Favor", "Against", "Neutral", "NA", None]
    rows = []
    for _ in range(count):
        # few distinct times, so that ties occur; some times unknown
        time = NOON + timedelta(minutes=rng.randrange(3000 if not hot_hour or rng.random() > 0.4 else 3))
        rows.append({
            "dt_stamp": None if rng.random() < 0.05 else time,
            "vid_id": rng.choice(["hot", "hot", "cold"]),
            "senti": rng.choice(["Pos", "Neg", "Neut", "NA"]),
            **{s: rng.choice(stances) for s in ("sg", "mil", "rnr")},
            "societal_impact": "Favor" if rng.random() < 0.03 else "NA",  # a rare facet, and an empty one
        })
    return rows, messages(spark, *rows)


def _expected(rows, n, video=None):
    out = {}
    for section, label in FACETS:
        hits = [(r["dt_stamp"] or datetime.min, i) for i, r in enumerate(rows, 1)
                if r[SECTION_COLUMNS[section]] == label and video in (None, r["vid_id"])]
        out[section, label] = [i for _, i in sorted(hits, reverse=True)[:n]]
    return out


@pytest.mark.parametrize("n, hot_hour", [(3, False), (30, True), (1000, False)])
def test_latest_per_facet_by_brute_force(spark, n, hot_hour):
    rows, df = _random_messages(spark, 400, n, hot_hour)
    got = {}
    for r in facets.latest_per_facet(df.repartition(7), n).orderBy("section", "label", "rank").collect():
        got.setdefault((r["section"], r["label"]), []).append(r["id"])
    assert got == {k: v for k, v in _expected(rows, n).items() if v}


def test_latest_per_facet_and_video(spark):
    rows, df = _random_messages(spark, 300, 5)
    for broadcast_bytes in (0, None):
        got = {}
        latest = facets.latest_per_facet(df.repartition(5), 4, ["vid_id"], None, broadcast_bytes)
        for r in latest.orderBy("rank").collect():
            got.setdefault((r["vid_id"], r["section"], r["label"]), []).append(r["id"])
        for video in ("hot", "cold"):
            for key, ids in _expected(rows, 4, video).items():
                assert got.get((video, *key), []) == ids


def test_whole_messages_are_carried(spark):
    df = messages(spark, {"sg": "Favor", "senti": "Pos"}).selectExpr("*", "length(message) AS n_chars")
    rows = facets.latest_per_facet(df).collect()
    assert sorted(r["section"] for r in rows) == ["sentiment", "sg"]
    assert set(rows[0].asDict()) == {*df.columns, "section", "label", "rank"} - {"n_chars"}
    assert all((r["sg"], r["senti"], r["author"]) == ("Favor", "Pos", "a") for r in rows)
    few = facets.latest_per_facet(df, columns=["id", "dt_stamp"])
    assert set(few.columns) == {"section", "label", "id", "dt_stamp", "rank"}


def test_empty_facets_show_up(spark):
    df = messages(spark, {"sg": "Favor"})
    rows = {(r["section"], r["label"]): (r["n"], len(r["messages"])) for r in facets.facet_messages(df).collect()}
    assert len(rows) == 10 and rows["sg", "Favor"] == (1, 1) and rows["military", "Against"] == (0, 0)
    nested = {r["section"]: r["breakdown"] for r in facets.facet_nested(df).collect()}
    assert {k: len(v) for k, v in nested["sg"].items()} == {"Favor": 1, "Against": 0}
    assert list(nested["sentiment"]) == ["Pos", "Neg"]


def test_sufficiency_at_the_threshold(spark):
    df = messages(spark, *[{"sg": "Favor"}] * 3, *[{"sg": "Against"}] * 2, *[{"mil": "Favor"}] * 4)
    rows = {(r["section"], r["label"]): r for r in facets.facet_sufficiency(df, 3).collect()}
    assert rows["sg", "Favor"]["sufficient"] and rows["sg", "Favor"]["note"] is None
    assert rows["military", "Favor"]["found"] == 3
    assert rows["sg", "Against"]["note"] == "Insufficient messages for Against, only 2 messages found."
    assert rows["sentiment", "Pos"]["note"] == "Insufficient messages for Positive, only 0 messages found."
    corpora = facets.facet_corpus(df, 3, preamble="P:").collect()
    assert {(r["section"], r["label"]) for r in corpora} == {("sg", "Favor"), ("military", "Favor")}
    assert corpora[0]["corpus"] == "P:" + "\n".join(["long enough"] * 3)


def test_key_terms(spark):
    df = messages(spark, {"sg": "Favor", "message": "Große große Straße, தமிழ் ok ok ok"},
                  {"sg": "Favor", "message": "STRASSE straße über"})
    got = [(r["term"], r["n"], r["rank"])
           for r in facets.facet_key_terms(df, k=3).where("section = 'sg'").orderBy("rank").collect()]
    assert got == [("ok", 3, 1), ("große", 2, 2), ("straße", 2, 3)]
    everything = {r["term"] for r in facets.facet_key_terms(df, k=50).collect()}
    assert {"தமிழ்", "ok"} <= everything and "" not in everything
    short = messages(spark, {"sg": "Favor", "message": "我们 支持 我们 NS 好"})
    assert {r["term"]: r["n"] for r in facets.facet_key_terms(short).collect()} == {"我们": 2, "支持": 1, "ns": 1, "好": 1}


def test_summary_run(spark, tmp_path):
    df = messages(spark, *[{"sg": "Favor", "message": f"number {i} parade"} for i in range(3)])
    path = str(tmp_path / "summaries")
    append_summaries(summary_run(df, AT, n=3), path)
    append_summaries(summary_run(df, AT, n=3, fn=lambda text: str(text.count("parade"))), path)
    records = spark.read.parquet(path)
    assert records.count() == 20
    found = {r["summary"] for r in records.where("section = 'sg' AND label = 'Favor'").collect()}
    assert found == {"number, parade", "3"}
    assert records.where("label = 'Against' AND summary IS NOT NULL").count() == 0
    nested = summaries.nested_record(summary_run(df, AT, n=3)).first()
    assert nested["sections"]["sg"]["Favor"]["summary"] == "number, parade"
    assert len(nested["sections"]["sg"]["Favor"]["messages"]) == 3 and len(nested["sections"]) == 5

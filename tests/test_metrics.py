import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import NOON, messages

from chatlens.functions.rounding import tenths_exact, tenths_scaled
from chatlens.operators import metrics, timeline
from chatlens.plans.dashboard import dashboard_overview, panels


def test_sentiment_spellings_merge_and_na_drops(spark):
    df = messages(
        spark, {"senti": "Pos"}, {"senti": "pos"}, {"senti": "NA"}, {"senti": None}, {"senti": "NEG"},
        {"senti": "not applicable"})
    found = [(r["sentiment"], r["n"]) for r in metrics.sentiment_distribution(df).collect()]
    assert found == [("Positive", 2), (None, 1), ("Negative", 1)]


def test_flag_rates(spark):
    df = messages(spark, {"troll": True}, {"troll": None}, {"troll": False})
    rows = {r["flag"]: (r["n"], r["n_total"], r["pct"], r["text"]) for r in metrics.flag_rates(df).collect()}
    assert rows == {"troll": (1, 3, 33.3, "1 of 3 (33.3%)"), "toxic": (0, 3, 0.0, "Not Applicable")}
    rows = {r["flag"]: (r["n"], r["pct"], r["text"]) for r in metrics.flag_rates(df.where("false")).collect()}
    assert rows == {"troll": (0, None, "Not Applicable"), "toxic": (0, None, "Not Applicable")}


def test_rounding(spark):
    pairs = [(n, total) for total in (7, 80, 400, 2000, 4000, 6000) for n in range(0, total + 1, 1 + total // 700)]
    pairs += [(247, 2000), (1, 10**9), (10**12 + 7, 3 * 10**12)]
    x = F.col("n") / F.col("total") * 100.0
    df = spark.createDataFrame(pairs, "n long, total long").select("n", "total", tenths_exact(x), tenths_scaled(x))
    for n, total, exact, scaled in df.collect():
        assert exact == round(n / total * 100, 1), (n, total)
        assert scaled == float(np.round(np.float64(n / total * 100), 1)), (n, total)


def test_language_shares(spark):
    df = messages(spark, {"lang": "EN"}, {"lang": "EN"}, {"lang": "MS"}, {"lang": None})
    assert [tuple(r) for r in metrics.language_distribution(df).collect()] == [
        ("EN", 2, 66.7, "2 (66.7%)"), ("MS", 1, 33.3, "1 (33.3%)")]


def test_bucket_with_only_neutral_exists(spark):
    df = messages(
        spark, {"sg": "Neutral", "mil": None}, {"sg": None, "mil": None},
        {"sg": "Favor", "dt_stamp": NOON + timedelta(hours=1)}, {"sg": "Favor", "dt_stamp": None})
    rows = {(r["stance"], r["bucket_start"].hour): (r["favor"], r["against"])
            for r in timeline.stance_timeline(df).where("stance IN ('sg', 'mil')").collect()}
    assert rows == {("sg", 12): (0, 0), ("sg", 13): (1, 0), ("mil", 13): (0, 0)}


@pytest.mark.parametrize("minutes, width", [(15, 1), (15.1, 5), (60, 5), (60.1, 10), (120, 10), (121, 15)])
def test_bucket_width_follows_the_span(spark, minutes, width):
    end = NOON + timedelta(minutes=minutes)
    df = messages(spark, {"sg": "Favor"}, {"sg": "Against", "dt_stamp": end})
    for by in ([], ["vid_id"]):
        rows = timeline.stance_timeline_adaptive(df, by).where("stance = 'sg'").collect()
        assert {r["width"] for r in rows} == {width}
        floor = end.replace(second=0) - timedelta(minutes=end.minute % width)
        assert {r["bucket_start"] for r in rows} == {NOON, floor}


def test_each_video_has_its_own_width(spark):
    rng = random.Random(7)
    rows, spans = [], {"a": 10, "b": 50, "c": 110, "d": 500}
    for vid, span in spans.items():
        rows += [{"vid_id": vid, "sg": rng.choice(["Favor", "Against", "NA", None]),
                  "dt_stamp": NOON + timedelta(seconds=rng.randrange(span * 60))} for _ in range(60)]
        rows += [{"vid_id": vid, "dt_stamp": NOON}, {"vid_id": vid, "dt_stamp": NOON + timedelta(minutes=span)}]
    widths = {"a": 1, "b": 5, "c": 10, "d": 15}
    expected = Counter()
    seen = set()
    for r in rows:
        if r.get("sg", "NA") is None:
            continue
        since_midnight = (r["dt_stamp"] - datetime(2024, 3, 1)).total_seconds() // 60
        start = datetime(2024, 3, 1) + timedelta(minutes=since_midnight - since_midnight % widths[r["vid_id"]])
        seen.add((r["vid_id"], start))
        expected[r["vid_id"], start, r.get("sg", "NA")] += 1
    got = timeline.stance_timeline_adaptive(messages(spark, *rows), ["vid_id"]).where("stance = 'sg'").collect()
    assert {(g["vid_id"], g["bucket_start"]) for g in got} == seen
    for g in got:
        key = (g["vid_id"], g["bucket_start"])
        assert (g["favor"], g["against"]) == (expected[*key, "Favor"], expected[*key, "Against"])


def test_peaks_and_missing_stance_column(spark):
    df = messages(spark, {"sg": "Favor"}, {"sg": "Favor"}, {"sg": "Against"}).drop("mil")
    peaks = {r["stance"]: r["peak"] for r in timeline.stance_peaks(df).collect()}
    assert peaks == {"sg": 2, "rnr": 0, "societal_impact": 0}


def test_overview_of_nothing_labelled(spark):
    df = messages(spark, {"enriched": False})
    rows = {(r["panel"], r["item"]): (r["n"], r["text"]) for r in dashboard_overview(df).collect()}
    assert rows.pop(("corpus", "not_enriched")) == (1, None) and rows.pop(("corpus", "enriched")) == (0, None)
    assert rows.pop(("flag", "troll")) == rows.pop(("flag", "toxic")) == (0, "Not Applicable")
    assert len(rows) == 12 and set(rows.values()) == {(0, None)}  # three kinds of four stances


def test_overview_keeps_unmapped_sentiments_and_an_empty_backlog(spark):
    df = messages(spark, {"senti": "Odd"}, {"senti": "Pos"}, {"senti": "NA"})
    rows = {(r["panel"], r["item"]): r["n"] for r in dashboard_overview(df).collect()}
    assert rows["corpus", "not_enriched"] == 0 and rows["corpus", "enriched"] == 3
    assert {k: n for k, n in rows.items() if k[0] == "sentiment"} == {("sentiment", None): 1, ("sentiment", "Positive"): 1}


def test_panels(spark):
    df = messages(spark, {"sg": "Favor", "troll": True}, {"enriched": False}, {"delete": True})
    shown = {name: panel.collect() for name, panel in panels(df).items()}
    assert [r["n"] for r in shown["sentiment"]] == [1] and tuple(shown["counts"][0]) == (1, 1)
    assert {r["flag"]: r["text"] for r in shown["flags"]} == {"troll": "1 of 1 (100.0%)", "toxic": "Not Applicable"}
    assert {(r["stance"], r["favor"]) for r in shown["timeline"]} == {
        ("sg", 1), ("mil", 0), ("rnr", 0), ("societal_impact", 0)}
    assert [r["text"] for r in shown["languages"]] == ["1 (100.0%)"]
    assert {r["stance"]: r["favor"] for r in shown["stances"]}["sg"] == 1

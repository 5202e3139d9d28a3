"""Hand-made message rows."""

from datetime import datetime

from chatlens.schema import MESSAGES, REGISTRY

NOON = datetime(2024, 3, 1, 12, 0, 0)

_DEFAULTS = {
    "vid_id": "v1", "author": "a", "author_id": "x", "dt_stamp": NOON, "message": "long enough",
    "enriched": True, "sg": "NA", "mil": "NA", "rnr": "NA", "societal_impact": "NA", "lang": "EN",
    "senti": "Neut", "troll": False, "toxic": False, "dt_enriched": None, "delete": None,
}


def messages(spark, *rows):
    """Messages 1, 2, ... with defaults for what a row does not say."""
    full = []
    for i, row in enumerate(rows, 1):
        values = {"id": i, **_DEFAULTS, **row}
        values.setdefault("msg_id", f"m{values['id']}")
        full.append(tuple(values[f.name] for f in MESSAGES.fields))
    return spark.createDataFrame(full, MESSAGES)


def urls(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def registry(spark, *rows):
    return spark.createDataFrame(list(rows), REGISTRY)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())

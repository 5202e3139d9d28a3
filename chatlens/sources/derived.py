"""Test views: chat tables derived from the given events, documents, pages, lineitem and
conversations. Integer arithmetic and plain text only, so SQL can rebuild every row.
"""

from functools import reduce

from pyspark.sql import functions as F

from chatlens.sources.tables import stream_messages

# Declared, so that no query starts by opening files to infer a schema.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
}
_LATE = 10**15

_CYCLE = "array('Favor', 'Against', 'Neutral', 'NA')"
_EVENT_LABELS = [
    f"element_at({_CYCLE}, int((event_id + {k} * user_id) % 4 + 1)) AS {name}"
    for k, name in enumerate(["sg", "mil", "rnr", "societal_impact"])
] + ["element_at(array('Pos', 'Neg', 'Neut', 'NA'), int(user_id % 4 + 1)) AS senti"]
_DELETE_FLAG = "CASE event_id % 17 WHEN 0 THEN true WHEN 1 THEN false END AS delete"


def table(spark, sf_dir, name):
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark, sf_dir, name):
    return stream_messages(spark, sf_dir, schema=SCHEMAS[name], glob=f"{name}.parquet")


def live_from(events):
    """One message per event; works on a batch or a streaming read."""
    return events.selectExpr(
        "event_id + 1 AS id",
        "concat('v', user_id % 20) AS vid_id",
        "concat('user', user_id) AS author",
        "concat('a', user_id) AS author_id",
        "ts AS dt_stamp",
        "concat('m', event_id) AS msg_id",
        "CASE WHEN event_id % 11 = 0 THEN substr(event_type, 1, 5)"
        " ELSE concat(event_type, ' ', props) END AS message",
        "event_id % 5 <> 0 AS enriched",
        *_EVENT_LABELS,
        "CASE event_id % 7 WHEN 0 THEN 'MS' WHEN 1 THEN 'ZH' WHEN 2 THEN 'TA' WHEN 3 THEN 'Other'"
        " ELSE 'EN' END AS lang",
        "CASE WHEN event_id % 13 <> 0 THEN value > 100 END AS troll",
        "event_type = 'error' AS toxic",
        _DELETE_FLAG,
    )


def live(spark, sf_dir):
    return live_from(table(spark, sf_dir, "events"))


def live_stream(spark, sf_dir):
    return live_from(table_stream(spark, sf_dir, "events"))


def docmsg(spark, sf_dir):
    """Documents as messages, with the label table's coverage and the events' stances."""
    documents, events, labels = (table(spark, sf_dir, n) for n in ("documents", "events", "labels"))
    rows = documents.join(events, F.expr("event_id = doc_id"), "left").join(
        labels.withColumn("labelled", F.lit(True)), "doc_id", "left"
    )
    return rows.selectExpr(
        "doc_id + 1 AS id",
        "source AS vid_id",
        "concat('user', user_id) AS author",
        "concat('a', user_id) AS author_id",
        "ts AS dt_stamp",
        "concat('d', doc_id) AS msg_id",
        "text AS message",
        "coalesce(labelled, false) AS enriched",
        *_EVENT_LABELS,
        "lang",
        "quality = 0 AS troll",
        "toxic = 1 AS toxic",
        "CAST(NULL AS boolean) AS delete",
    )


def registry(spark, sf_dir):
    """One watched URL per video of `live`."""
    return table(spark, sf_dir, "events").selectExpr("user_id % 20 AS k").distinct().selectExpr(
        "concat('https://video.example/watch?v=v', k) AS url",
        "'YouTube' AS platform",
        "CASE WHEN k % 3 = 0 THEN 'start' ELSE 'stopped' END AS status",
    )


def page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url")


def drop_list(spark, sf_dir):
    """URLs somebody wants dropped: every stopped video, and pages that name none of ours."""
    stopped = registry(spark, sf_dir).where("status = 'stopped'").select("url")
    return stopped.unionByName(page_urls(spark, sf_dir))


def label_updates_from(lineitem):
    """A label feed: many corrections per message, some ids unknown, some labels cleared."""
    stance = "CASE l_returnflag WHEN 'R' THEN 'Favor' WHEN 'A' THEN 'Against' ELSE 'Neutral' END"
    return lineitem.selectExpr(
        "l_orderkey + 1 AS id",
        f"{stance} AS sg",
        f"CASE WHEN l_linestatus = 'F' THEN {stance} ELSE 'NA' END AS mil",
        f"CASE WHEN l_discount > 0.05D THEN {stance} END AS rnr",
        f"CASE WHEN l_tax > 0.04D THEN {stance} ELSE 'Neutral' END AS societal_impact",
        "CASE WHEN l_linestatus = 'F' THEN 'EN' ELSE 'TA' END AS lang",
        "CASE l_returnflag WHEN 'R' THEN 'Pos' WHEN 'A' THEN 'Neg' END AS senti",
        "l_discount > 0.05D AS troll",
        "l_tax > 0.06D AS toxic",
        "bigint(l_linenumber) AS seq",
        "l_shipdate AS sent_at",
        "l_partkey AS part",
        "l_suppkey AS supp",
    )


UPDATE_ORDER = ["seq", "sent_at", "part", "supp"]


def label_updates(spark, sf_dir):
    return label_updates_from(table(spark, sf_dir, "lineitem"))


def label_update_stream(spark, sf_dir):
    return label_updates_from(table_stream(spark, sf_dir, "lineitem"))


def incoming(spark, sf_dir):
    """A collector's batch: all stored messages again, conversation turns as new messages,
    and a later copy of each turn that must lose.
    """
    turns = table(spark, sf_dir, "conversations").selectExpr(
        "concat('c', conv_id) AS vid_id",
        "role AS author",
        "role AS author_id",
        "CAST(NULL AS timestamp_ntz) AS dt_stamp",
        "concat('c-', conv_id, '-', turn) AS msg_id",
        "text AS message",
        "conv_id * 1000000 + turn AS arrival",
    )
    later = turns.withColumns({"message": F.lit("later copy"), "arrival": F.expr(f"arrival + {_LATE}")})
    again = live(spark, sf_dir).selectExpr(*turns.columns[:-1], f"id - {_LATE} AS arrival")
    return reduce(lambda a, b: a.unionByName(b), [again, turns, later])


def edited(spark, sf_dir):
    return reviewed(live(spark, sf_dir))


def reviewed(messages):
    """Messages after a reviewer's pass: no stance on toxic messages, troll cleared for one video."""
    return messages.withColumns({
        "sg": F.expr("CASE WHEN toxic THEN 'NA' ELSE sg END"),
        "troll": F.expr("CASE WHEN vid_id <> 'v9' THEN troll END"),
    })

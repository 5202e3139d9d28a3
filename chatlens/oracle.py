"""The same results in ANSI SQL, for DuckDB on the same tables."""

from chatlens.operators.facets import PREAMBLE
from chatlens.schema import (
    DOMAINS,
    FACETS,
    LABEL_TITLES,
    LABELS,
    SECTION_COLUMNS,
    SECTION_TITLES,
    SENTIMENT_NAMES,
    STANCE_TITLES,
    STANCES,
)

AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"


def _text(s):
    return "'" + s.replace("'", "''") + "'"


def _list(values):
    return "(" + ", ".join(map(_text, values)) + ")"


def _case(column, names):
    return f"CASE {column} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in names.items()) + " END"


def _stance(k):
    return f"(['Favor','Against','Neutral','NA'])[(event_id + {k} * user_id) % 4 + 1]"


_EVENT_LABELS = f"""
    {_stance(0)} AS sg, {_stance(1)} AS mil, {_stance(2)} AS rnr, {_stance(3)} AS societal_impact,
    (['Pos','Neg','Neut','NA'])[user_id % 4 + 1] AS senti"""
_DELETE = 'CASE event_id % 17 WHEN 0 THEN true WHEN 1 THEN false END AS "delete"'

VIEWS = {
    "live": f"""
  SELECT event_id + 1 AS id, 'v' || (user_id % 20) AS vid_id, 'user' || user_id AS author,
    'a' || user_id AS author_id, ts AS dt_stamp, 'm' || event_id AS msg_id,
    CASE WHEN event_id % 11 = 0 THEN substr(event_type, 1, 5) ELSE event_type || ' ' || props END AS message,
    event_id % 5 <> 0 AS enriched, {_EVENT_LABELS},
    CASE event_id % 7 WHEN 0 THEN 'MS' WHEN 1 THEN 'ZH' WHEN 2 THEN 'TA' WHEN 3 THEN 'Other' ELSE 'EN' END AS lang,
    CASE WHEN event_id % 13 <> 0 THEN value > 100 END AS troll, event_type = 'error' AS toxic, {_DELETE}
  FROM events""",
    "docmsg": f"""
  SELECT d.doc_id + 1 AS id, source AS vid_id, 'user' || user_id AS author, 'a' || user_id AS author_id,
    ts AS dt_stamp, 'd' || d.doc_id AS msg_id, text AS message, l.doc_id IS NOT NULL AS enriched,
    {_EVENT_LABELS}, lang, quality = 0 AS troll, toxic = 1 AS toxic, NULL::BOOLEAN AS "delete"
  FROM documents d LEFT JOIN events ON event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "visible": "SELECT * FROM live WHERE enriched AND length(message) > 5 AND NOT coalesce(\"delete\", false)",
    "visible_doc": "SELECT * FROM docmsg WHERE enriched AND length(message) > 5 AND NOT coalesce(\"delete\", false)",
    "registry": """
  SELECT DISTINCT 'https://video.example/watch?v=v' || (user_id % 20) AS url, 'YouTube' AS platform,
    CASE WHEN user_id % 20 % 3 = 0 THEN 'start' ELSE 'stopped' END AS status
  FROM events""",
    "drop_list": "SELECT url FROM registry WHERE status = 'stopped' UNION SELECT url FROM pages",
    "drop_keys": "SELECT DISTINCT split_part(url, '=', 2) AS vid_id FROM drop_list WHERE contains(url, '=')",
    "all_urls": "SELECT url FROM registry UNION SELECT url FROM pages",
    "updates": """
  SELECT l_orderkey + 1 AS id,
    CASE l_returnflag WHEN 'R' THEN 'Favor' WHEN 'A' THEN 'Against' ELSE 'Neutral' END AS sg,
    CASE WHEN l_linestatus <> 'F' THEN 'NA' WHEN l_returnflag = 'R' THEN 'Favor'
      WHEN l_returnflag = 'A' THEN 'Against' ELSE 'Neutral' END AS mil,
    CASE WHEN l_discount > 0.05::DOUBLE THEN
      CASE l_returnflag WHEN 'R' THEN 'Favor' WHEN 'A' THEN 'Against' ELSE 'Neutral' END END AS rnr,
    CASE WHEN NOT l_tax > 0.04::DOUBLE THEN 'Neutral' WHEN l_returnflag = 'R' THEN 'Favor'
      WHEN l_returnflag = 'A' THEN 'Against' ELSE 'Neutral' END AS societal_impact,
    CASE l_linestatus WHEN 'F' THEN 'EN' ELSE 'TA' END AS lang,
    CASE l_returnflag WHEN 'R' THEN 'Pos' WHEN 'A' THEN 'Neg' END AS senti,
    l_discount > 0.05::DOUBLE AS troll, l_tax > 0.06::DOUBLE AS toxic, l_linenumber AS seq,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS age
  FROM lineitem""",
    "final_updates": "SELECT * FROM updates WHERE age = 1",
    "early_updates": """
  SELECT * FROM updates WHERE seq <= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY age) = 1""",
    "late_updates": """
  SELECT * FROM updates WHERE seq > 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY age) = 1""",
    "incoming": """
  SELECT vid_id, author, author_id, dt_stamp, msg_id, message, id - 1000000000000000 AS arrival FROM live
  UNION ALL
  SELECT 'c' || conv_id, role, role, NULL, 'c-' || conv_id || '-' || turn, text, conv_id * 1000000 + turn
  FROM conversations
  UNION ALL
  SELECT 'c' || conv_id, role, role, NULL, 'c-' || conv_id || '-' || turn, 'later copy',
    conv_id * 1000000 + turn + 1000000000000000
  FROM conversations""",
    "fresh": """
  SELECT row_number() OVER (ORDER BY arrival, msg_id) + (SELECT max(id) FROM live) AS id,
    vid_id, author, author_id, dt_stamp, msg_id, message, false AS enriched
  FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY arrival) AS copy FROM incoming)
  WHERE copy = 1 AND msg_id NOT IN (SELECT msg_id FROM live)""",
    "edited": """
  SELECT * REPLACE (CASE WHEN toxic THEN 'NA' ELSE sg END AS sg,
    CASE WHEN vid_id <> 'v9' THEN troll END AS troll)
  FROM live""",
    "facet_dim": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{s}', '{v}')" for i, (s, v) in enumerate(FACETS)) + ") AS f(position, section, label)",
}


def _ranked(source, keys=""):
    branches = " UNION ALL ".join(
        f"SELECT *, '{section}' AS section, '{label}' AS label FROM {source} "
        f"WHERE {SECTION_COLUMNS[section]} = '{label}'"
        for section, label in FACETS
    )
    return f"""
  SELECT *, row_number() OVER (
    PARTITION BY {keys} section, label ORDER BY dt_stamp DESC NULLS LAST, id DESC) AS rank
  FROM ({branches})"""


VIEWS["latest"] = f"SELECT * FROM ({_ranked('visible')}) WHERE rank <= 30"
VIEWS["latest_doc"] = f"SELECT * FROM ({_ranked('visible_doc')}) WHERE rank <= 30"


def _terms(k):
    return f"""
  SELECT section, label, term, n, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY section, label ORDER BY n DESC, term) AS rank FROM (
      SELECT section, label, term, count(*) AS n FROM (
        SELECT section, label,
          unnest(regexp_split_to_array(lower(message), '[^\\p{{L}}\\p{{M}}]+')) AS term
        FROM latest_doc)
      WHERE term <> '' GROUP BY ALL))
  WHERE rank <= {k}"""


VIEWS["corpora"] = f"""
  SELECT section, label, count(*) AS n,
    {_text(PREAMBLE)} || string_agg(message, chr(10) ORDER BY rank) AS corpus
  FROM latest_doc GROUP BY section, label HAVING count(*) >= 30"""

_USES = {
    "visible": ["live"], "visible_doc": ["docmsg"], "drop_list": ["registry"], "drop_keys": ["drop_list"],
    "all_urls": ["registry"], "final_updates": ["updates"], "early_updates": ["updates"],
    "late_updates": ["updates"], "incoming": ["live"], "fresh": ["incoming"],
    "edited": ["live"], "latest": ["visible"], "latest_doc": ["visible_doc"], "corpora": ["latest_doc"],
}


def _needed(names):
    out = []
    for name in names:
        for used in [*_needed(_USES.get(name, [])), name]:
            if used not in out:
                out.append(used)
    return out


def _with(names, body):
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _needed(names))
    return f"WITH {ctes}\n{body}"


def _pct(n, total):
    return f"({n})::DOUBLE / ({total}) * 100"


def _exact(x):
    return f"printf('%.1f', {x})::DOUBLE"


def _scaled(x):
    return f"round_even({x} * 10, 0) / 10"


def _flag_rates(source):
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n, count(*) AS n_total FROM {source}"
        for f in ("troll", "toxic")
    )
    pct = _exact(_pct("n", "nullif(n_total, 0)"))
    return f"""SELECT *, CASE WHEN n = 0 THEN 'Not Applicable'
  ELSE printf('%d of %d (%.1f%%)', n, n_total, pct) END AS text
FROM (SELECT *, {pct} AS pct FROM ({rows}))"""


def _languages(source):
    pct = _scaled(_pct("n", "sum(n) OVER ()"))
    return f"""SELECT *, printf('%d (%.1f%%)', n, pct) AS text
FROM (SELECT *, {pct} AS pct
  FROM (SELECT lang, count(*) AS n FROM {source} WHERE lang IS NOT NULL GROUP BY lang))"""


_STANCE_TOTALS = " UNION ALL ".join(
    f"SELECT '{s}' AS stance, '{STANCE_TITLES[s]}' AS title, count(*) FILTER ({s} = 'Favor') AS favor, "
    f"count(*) FILTER ({s} = 'Neutral') AS neutral, count(*) FILTER ({s} = 'Against') AS against FROM visible"
    for s in STANCES
)


def _timeline(width="INTERVAL 15 MINUTE", keys="", source="visible"):
    return " UNION ALL ".join(
        f"SELECT {keys} time_bucket({width}, dt_stamp, TIMESTAMP '2000-01-01') AS bucket_start, "
        f"'{s}' AS stance, count(*) FILTER ({s} = 'Favor') AS favor, "
        f"count(*) FILTER ({s} = 'Against') AS against FROM {source} "
        f"WHERE dt_stamp IS NOT NULL AND {s} IS NOT NULL GROUP BY ALL"
        for s in STANCES
    )


def _widths(keys=""):
    by = f"PARTITION BY {keys}" if keys else ""
    first, last = (f"{fn}(dt_stamp) OVER ({by})" for fn in ("min", "max"))
    return f"""SELECT *, CASE WHEN last_at - first_at <= INTERVAL 15 MINUTE THEN 1
    WHEN last_at - first_at <= INTERVAL 60 MINUTE THEN 5
    WHEN last_at - first_at <= INTERVAL 120 MINUTE THEN 10 ELSE 15 END AS width
  FROM (SELECT *, {first} AS first_at, {last} AS last_at FROM visible WHERE dt_stamp IS NOT NULL)"""


_SENTIMENTS = f"""SELECT {_case("key", SENTIMENT_NAMES)} AS sentiment, n
FROM (SELECT upper(senti[1]) || lower(senti[2:]) AS key, count(*) AS n FROM visible GROUP BY ALL)
WHERE key <> 'Na'"""

_OVERVIEW = f"""
SELECT 'corpus' AS panel, unnest(['not_enriched', 'enriched']) AS item, unnest([
  count(*) FILTER (NOT enriched AND length(message) > 5),
  count(*) FILTER (enriched AND length(message) > 5 AND NOT coalesce("delete", false))]) AS n,
  NULL::DOUBLE AS pct, NULL AS text FROM live
UNION ALL SELECT 'sentiment', sentiment, n, NULL, NULL FROM ({_SENTIMENTS})
UNION ALL SELECT 'language', lang, n, pct, text FROM ({_languages('visible')})
UNION ALL SELECT 'flag', flag, n, pct, text FROM ({_flag_rates('visible')})
UNION ALL SELECT stance, unnest(['Favor', 'Neutral', 'Against']), unnest([favor, neutral, against]), NULL, NULL
FROM ({_STANCE_TOTALS})"""


def _sufficiency(source):
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{label}' AS label, '{SECTION_TITLES[section]}' AS title, "
        f"least(count(*), 30) AS found, count(*) >= 30 AS sufficient, CASE WHEN count(*) < 30 THEN "
        f"'Insufficient messages for {LABEL_TITLES[label]}, only ' || count(*) || ' messages found.' END AS note "
        f"FROM {source} WHERE {SECTION_COLUMNS[section]} = '{label}'"
        for section, label in FACETS
    )


def _violations(source):
    return " UNION ALL ".join(
        f"SELECT id, '{c}' AS field, {c} AS value FROM {source} "
        f"WHERE {c} IS NULL OR {c} NOT IN {_list(values)}"
        for c, values in DOMAINS.items()
    )


_MESSAGE_COLUMNS = [
    "id", "vid_id", "author", "author_id", "dt_stamp", "msg_id", "message", "enriched",
    "sg", "mil", "rnr", "societal_impact", "senti", "lang", "troll", "toxic", "delete",
]


_SPELLED = "struct_pack(" + ", ".join(f'"{c}" := "{c}"::VARCHAR' for c in ["rank", *_MESSAGE_COLUMNS]) + ")"


def _upsert(join, stamp, source="final_updates"):
    columns = []
    for c in _MESSAGE_COLUMNS:
        if c == "id":
            columns.append("coalesce(t.id, u.id) AS id")
        elif c == "enriched":
            columns.append("CASE WHEN u.id IS NOT NULL THEN true ELSE t.enriched END AS enriched")
        elif c in LABELS:
            columns.append(f"CASE WHEN u.id IS NOT NULL THEN u.{c} ELSE t.{c} END AS {c}")
        else:
            columns.append(f't."{c}"')
    if stamp:
        columns.append(f"CASE WHEN u.id IS NOT NULL THEN {AS_OF} END AS dt_enriched")
    return f"SELECT {', '.join(columns)} FROM live t {join} JOIN {source} u ON t.id = u.id"


def _differs():
    def shown(c):
        return f"coalesce({c}, false)" if c.endswith(("troll", "toxic")) else c

    return " OR ".join(f"{shown('e.' + c)} IS DISTINCT FROM {shown('o.' + c)}" for c in LABELS)


def _folded_labels():
    """Early updates, a correction of what they gave, late updates: per message the last of the three."""
    labels = ", ".join(LABELS)
    return f"""SELECT * FROM (
  WITH seen AS ({_upsert("FULL", True, "early_updates")}),
  reviewed AS (SELECT * REPLACE (CASE WHEN toxic THEN 'NA' ELSE sg END AS sg,
    CASE WHEN vid_id <> 'v9' THEN troll END AS troll) FROM seen),
  corrected AS (SELECT e.id, {", ".join("e." + c for c in LABELS)} FROM reviewed e JOIN seen o ON e.id = o.id WHERE {_differs()}),
  applied AS (
    SELECT id, {labels} FROM late_updates
    UNION ALL SELECT id, {labels} FROM corrected WHERE id NOT IN (SELECT id FROM late_updates)
    UNION ALL SELECT id, {labels} FROM early_updates
      WHERE id NOT IN (SELECT id FROM late_updates) AND id NOT IN (SELECT id FROM corrected))
  {_upsert("FULL", True, "applied")})"""


_LATE = """SELECT id, dt_stamp, id % 3 AS batch FROM visible v
WHERE time_bucket(INTERVAL 15 MINUTE, dt_stamp, TIMESTAMP '2000-01-01') + INTERVAL 15 MINUTE
  <= (SELECT max(dt_stamp) FROM visible w WHERE w.id % 3 < v.id % 3) - INTERVAL 10 DAY"""

_DELETED_HALF = """SELECT * REPLACE (CASE WHEN id <= (SELECT max(id) // 2 FROM live) AND vid_id IN (SELECT vid_id FROM drop_keys)
  THEN true ELSE "delete" END AS "delete") FROM live"""

_DISPLAY = """id AS "ID", vid_id AS "Video Id", author AS "Author", dt_stamp AS "Create DateTime",
  message AS "Message", enriched AS "Enriched", sg AS "SG", mil AS "Military", rnr AS "RnR",
  societal_impact AS "Societal Impact", senti AS "Sentiment", lang AS "Language",
  coalesce(troll, false) AS "Troll", coalesce(toxic, false) AS "Toxic", "delete" """

_LEGACY = """id AS "ID", vid_id AS "Video Id", author AS "Author", author_id AS "Author Id",
  dt_stamp AS "Create DateTime", msg_id AS "Msg Id", message AS "Message", enriched AS "Enriched",
  societal_impact AS "Mishap", sg AS "SG", mil AS "Military", rnr AS "RnR", lang AS "Language",
  coalesce(troll, false) AS "Troll", coalesce(toxic, false) AS "Toxic", senti AS "Sentiment" """

_FRESH_COUNTS = """SELECT (SELECT count(*) FROM incoming) AS received, count(*) AS inserted,
  (SELECT count(*) FROM incoming) - count(*) - (SELECT count(*) FROM incoming WHERE msg_id IS NULL) AS skipped,
  (SELECT count(*) FROM incoming WHERE msg_id IS NULL) AS rejected FROM fresh"""

_MODIFIED = 'count(*) FILTER (NOT coalesce("delete", false))'

_SOFT_DELETE = """SELECT * REPLACE (
  CASE WHEN vid_id IN (SELECT vid_id FROM drop_keys) THEN true ELSE "delete" END AS "delete") FROM live"""

_EDITS = (
    f"SELECT e.id, {', '.join('e.' + c for c in LABELS)} FROM edited e JOIN live o ON e.id = o.id WHERE {_differs()}"
)

ORACLE = {
    "registry_listing": _with(["registry"], "SELECT url, platform, status FROM registry"),
    "active_urls": _with(["registry"], "SELECT url FROM registry WHERE status = 'start'"),
    "registry_status": _with(
        ["registry"], "SELECT status FROM registry WHERE url = 'https://video.example/watch?v=v3'"
    ),
    "registry_upsert": _with(["all_urls"], "SELECT url, 'YouTube' AS platform, 'start' AS status FROM all_urls"),
    "registry_upsert_counts": _with(
        ["all_urls"],
        """SELECT count(*) FILTER (url NOT IN (SELECT url FROM registry)) AS inserted,
  count(*) FILTER (url IN (SELECT url FROM registry)) AS updated FROM all_urls""",
    ),
    "registry_set_status": _with(
        ["drop_list"],
        """SELECT url, platform, CASE WHEN url IN (SELECT url FROM drop_list) THEN 'start' ELSE status END AS status
FROM registry""",
    ),
    "registry_stop": _with(
        ["drop_list"],
        """SELECT url, platform, CASE WHEN url IN (SELECT url FROM drop_list) THEN 'stopped' ELSE status END AS status
FROM registry""",
    ),
    "registry_delete": _with(
        ["drop_list"], "SELECT * FROM registry WHERE url NOT IN (SELECT url FROM drop_list)"
    ),
    "url_video_key":
        "SELECT url, CASE WHEN contains(url, '=') THEN split_part(url, '=', 2) END AS video_key FROM pages",
    "backlog_messages": _with(["live"], "SELECT * FROM live WHERE NOT enriched AND length(message) > 5"),
    "backlog_limit": _with(
        ["live"], "SELECT * FROM live WHERE NOT enriched AND length(message) > 5 ORDER BY id LIMIT 100"
    ),
    "visible_messages": _with(["visible"], "SELECT * FROM visible"),
    "visible_documents": _with(["visible_doc"], "SELECT * FROM visible_doc"),
    "messages_for_videos": _with(
        ["live", "drop_keys"],
        """SELECT * FROM live WHERE enriched AND length(message) > 5 AND vid_id IN (SELECT vid_id FROM drop_keys)""",
    ),
    "select_by_key": _with(
        ["live", "registry"],
        """SELECT id, vid_id, message FROM live
WHERE vid_id IN (SELECT split_part(url, '=', 2) FROM registry WHERE status = 'start')""",
    ),
    "domain_violations": _with(["visible"], _violations("visible")),
    "domain_violations_documents": _with(["visible_doc"], _violations("visible_doc")),
    "display_messages": _with(
        ["visible"], f'SELECT {_DISPLAY}, msg_id AS "Msg Id", author_id AS "Author Id" FROM visible'
    ),
    "editor_messages": _with(["visible"], f"SELECT {_DISPLAY} FROM visible"),
    "edit_payload": _with(
        ["edited"],
        """SELECT id, sg, mil, rnr, societal_impact, lang, senti, coalesce(troll, false) AS troll,
  coalesce(toxic, false) AS toxic FROM edited""",
    ),
    "legacy_messages": _with(["live"], f"SELECT {_LEGACY} FROM live"),
    "lenient_timestamps": """SELECT event_id, try_cast(ts::VARCHAR AS TIMESTAMP) AS "full",
  try_cast(substr(ts::VARCHAR, 1, 10) AS TIMESTAMP) AS "day", try_cast(props AS TIMESTAMP) AS junk FROM events""",
    "local_clock": "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') AS clock FROM events",
    "sentiment_distribution": _with(["visible"], _SENTIMENTS),
    "flag_rates": _with(["visible"], _flag_rates("visible")),
    "flag_rates_documents": _with(["visible_doc"], _flag_rates("visible_doc")),
    "stance_totals": _with(["visible"], _STANCE_TOTALS),
    "language_distribution": _with(["visible"], _languages("visible")),
    "language_distribution_documents": _with(["visible_doc"], _languages("visible_doc")),
    "corpus_counts": _with(
        ["live"],
        """SELECT count(*) FILTER (NOT enriched AND length(message) > 5) AS not_enriched,
  count(*) FILTER (enriched AND length(message) > 5 AND NOT coalesce("delete", false)) AS enriched FROM live""",
    ),
    "time_span": _with(
        ["visible"],
        """SELECT min(dt_stamp) AS first_at, max(dt_stamp) AS last_at,
  date_diff('microsecond', min(dt_stamp), max(dt_stamp)) / 60000000.0::DOUBLE AS minutes FROM visible""",
    ),
    "stance_timeline": _with(["visible"], _timeline()),
    "stance_timeline_adaptive": _with(
        ["visible"], f"SELECT * FROM ({_timeline('to_minutes(width)', 'width,', f'({_widths()})')})"
    ),
    "stance_timeline_by_video": _with(
        ["visible"],
        f"SELECT * FROM ({_timeline('to_minutes(width)', 'vid_id, width,', '(' + _widths('vid_id') + ')')})",
    ),
    "stance_peaks": _with(
        ["visible"], f"SELECT stance, max(greatest(favor, against)) AS peak FROM ({_timeline()}) GROUP BY stance"
    ),
    "dashboard_overview": _with(["visible"], _OVERVIEW),
    "latest_per_facet": _with(["latest"], "SELECT * FROM latest"),
    "latest_per_facet_100": _with(["visible"], f"SELECT * FROM ({_ranked('visible')}) WHERE rank <= 100"),
    "latest_per_facet_zoned": _with(["latest"], "SELECT * FROM latest"),
    "latest_per_facet_by_video": _with(
        ["visible"], f"SELECT * FROM ({_ranked('visible', 'vid_id,')}) WHERE rank <= 30"
    ),
    "facet_sufficiency": _with(["visible"], _sufficiency("visible")),
    "facet_sufficiency_documents": _with(["visible_doc"], _sufficiency("visible_doc")),
    "facet_nested": _with(
        ["latest", "facet_dim"],
        f"""SELECT section, to_json(map_from_entries(list((label, messages) ORDER BY position)))::VARCHAR AS breakdown
FROM (SELECT d.section, d.label, position, coalesce(list({_SPELLED} ORDER BY rank) FILTER (id IS NOT NULL), []) AS messages
  FROM facet_dim d LEFT JOIN latest USING (section, label) GROUP BY ALL)
GROUP BY section""",
    ),
    "facet_corpus": _with(["corpora"], "SELECT * FROM corpora"),
    "facet_key_terms": _with(["latest_doc"], _terms(10)),
    "facet_summaries": _with(
        ["corpora"], "SELECT section, label, n, length(corpus) || ' characters' AS summary FROM corpora"
    ),
    "summary_records": _with(
        ["latest_doc", "facet_dim"],
        f"""SELECT {AS_OF} AS generate_dt, d.section, d.label, coalesce(f.n, 0) AS n, coalesce(messages, '[]') AS messages,
  CASE WHEN f.n >= 30 THEN summary END AS summary
FROM facet_dim d
LEFT JOIN (SELECT section, label, count(*) AS n, to_json(list({_SPELLED} ORDER BY rank))::VARCHAR AS messages
  FROM latest_doc GROUP BY ALL) f ON d.section = f.section AND d.label = f.label
LEFT JOIN (SELECT section, label, string_agg(term, ', ' ORDER BY rank) AS summary
  FROM ({_terms(5)}) GROUP BY ALL) s ON d.section = s.section AND d.label = s.label""",
    ),
    "enrichment_upsert": _with(["live", "final_updates"], _upsert("FULL", True)),
    "enrichment_update_only": _with(["live", "final_updates"], _upsert("LEFT", False)),
    "edit_diff": _with(
        ["edited"], _EDITS
    ),
    "soft_delete": _with(["live", "drop_keys"], _SOFT_DELETE),
    "stored_soft_delete": _with(["live", "drop_keys"], _SOFT_DELETE),
    "stored_label_update": _with(["live", "final_updates"], _upsert("FULL", True)),
    "label_correction": _with(["edited"], _upsert("LEFT", True, f"({_EDITS})")),
    "json_lines_messages": _with(["live"], "SELECT * FROM live"),
    "json_lines_rejected": _with(
        ["live"], """SELECT '{"id": ' || id || ', "vid_id"' AS line FROM live WHERE id % 10 = 0"""
    ),
    "ingest_rejects": _with(
        ["incoming"],
        """SELECT vid_id, author, author_id, dt_stamp, NULL::VARCHAR AS msg_id, message, arrival FROM incoming
WHERE coalesce(length(message) % 7, 0) = 0""",
    ),
    "soft_delete_counts": _with(
        ["live", "drop_keys"],
        f"SELECT count(*) AS matched, {_MODIFIED} AS modified FROM live "
        "WHERE vid_id IN (SELECT vid_id FROM drop_keys)",
    ),
    "delete_counts": _with(
        ["live", "drop_keys"],
        f"""SELECT {_MODIFIED} AS modified_count,
  (SELECT count(*) FROM registry WHERE url IN (SELECT url FROM drop_list)) AS deleted_count
FROM live WHERE vid_id IN (SELECT vid_id FROM drop_keys)""",
    ),
    "ingest_new_messages": _with(["fresh"], "SELECT * FROM fresh"),
    "ingest_counts": _with(["fresh"], _FRESH_COUNTS),
    "sequence_ids": _with(
        ["live"],
        "SELECT row_number() OVER (ORDER BY dt_stamp, msg_id) AS seq_id, dt_stamp, msg_id, vid_id FROM live",
    ),
    "uniqueness_violations": _with(
        ["incoming"],
        """SELECT 'id' AS field, arrival::VARCHAR AS value, count(*) AS n FROM incoming GROUP BY arrival HAVING count(*) > 1
UNION ALL
SELECT 'msg_id', msg_id, count(*) FROM incoming GROUP BY msg_id HAVING count(*) > 1""",
    ),
    "stream_ingest_dedup": _with(
        ["live"],
        """SELECT row_number() OVER (ORDER BY dt_stamp, msg_id) AS id, vid_id, author, author_id, dt_stamp, msg_id,
  message, false AS enriched FROM live""",
    ),
    "stream_stance_timeline": _with(["visible"], _timeline()),
    "stream_enrichment_upsert": _with(["live", "final_updates"], _upsert("FULL", True)),
}

ORACLE |= {
    "stream_label_folds": _with(["live", "early_updates", "late_updates"], _folded_labels()),
    "stream_ingest_fold": _with(
        ["live"],
        """SELECT row_number() OVER (ORDER BY id % 3, dt_stamp, msg_id) AS id, vid_id, author, author_id, dt_stamp, msg_id,
  message, false AS enriched FROM live""",
    ),
    "append_rejects": _with(
        ["live"],
        """SELECT id, msg_id, 'msg_id stored' AS reason FROM live UNION ALL
SELECT 1000000000 + conv_id * 100 + turn, 'c-' || conv_id || '-' || turn, 'msg_id repeated' FROM conversations""",
    ),
    "stream_overview": ORACLE["dashboard_overview"],
    "stream_latest_per_facet": ORACLE["latest_per_facet"],
    "stream_timeline_adaptive": ORACLE["stance_timeline_adaptive"],
    "stream_timeline_by_video": ORACLE["stance_timeline_by_video"],
    "late_messages": _with(["visible"], _LATE),
    "late_counts": _with(
        ["visible"],
        f"""SELECT time_bucket(INTERVAL 15 MINUTE, dt_stamp, TIMESTAMP '2000-01-01') AS bucket_start, count(*) AS late
FROM ({_LATE}) GROUP BY ALL""",
    ),
    "late_repaired_timeline": ORACLE["stance_timeline"],
    "deletions_on_read": _with(["live", "drop_keys"], _DELETED_HALF),
    "deletions_folded": _with(["live", "drop_keys"], _DELETED_HALF),
    "facet_summary_outcomes": f"""SELECT section, label, length(corpus) || ' characters' AS summary,
  CASE WHEN length(corpus) % 2 = 1 THEN 3 ELSE 1 END::BIGINT AS tries, NULL::VARCHAR AS error FROM ({ORACLE["facet_corpus"]})""",
    "stream_line_counts": _with(
        ["live"],
        """SELECT landed + rejected + repeated AS received, landed, repeated, rejected FROM (
  SELECT count(*) AS landed, count(*) FILTER (id % 3 = 0) AS repeated,
    count(*) FILTER (id % 10 = 0) + count(*) FILTER (id % 7 = 0) AS rejected FROM live)""",
    ),
    "stream_line_rejects": _with(
        ["live"],
        """SELECT 'no JSON' AS reason, '{"id": ' || id || ', "vid_id"' AS shown FROM live WHERE id % 10 = 0
UNION ALL SELECT 'no msg_id', id::VARCHAR FROM live WHERE id % 7 = 0""",
    ),
    "store_reset": _with(
        ["live", "registry"],
        """SELECT 'filled' AS step, (SELECT count(*) FROM live) AS messages, (SELECT count(*) FROM registry) AS urls
UNION ALL SELECT 'cleared', 0, 0 UNION ALL SELECT 'filled again', count(*) FILTER (id % 2 = 0), 0 FROM live""",
    ),
    "summary_nested": f"""SELECT generate_dt, section, label, n, summary FROM ({ORACLE["summary_records"]})""",
    "registry_upsert_ordered": _with(
        ["registry"],
        """SELECT url, arg_max(platform, place) AS platform, 'start' AS status FROM (
  SELECT url, 'YouTube' AS platform, 2 AS place FROM registry UNION ALL
  SELECT url, CASE WHEN page_id % 2 = 0 THEN 'Web' ELSE 'Blog' END, page_id FROM pages) GROUP BY url""",
    ),
}

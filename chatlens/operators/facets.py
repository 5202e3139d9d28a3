"""The latest N messages of each (section, label) facet, and what is derived from them."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.text import terms
from chatlens.operators.metrics import as_rows
from chatlens.schema import FACET_SIZE, FACETS, LABEL_TITLES, SECTION_COLUMNS, SECTION_TITLES, SHORT_NOTE
from chatlens.sizing import measured_copy

_TEXT_ONLY = ["id", "dt_stamp", "message"]
_LAYOUT_ONLY = ["n_chars", "id_block"]
_SPREAD = 64
PREAMBLE = "Summarise these chat messages and name their key themes.\n\nMessages:\n"


def facet_dimension(spark):
    """The ten facets, so that empty ones show up as well."""
    rows = [(i, section, label) for i, (section, label) in enumerate(FACETS)]
    return spark.createDataFrame(rows, "position int, section string, label string")


def _shown(visible, columns):
    """The message columns to carry: all but those the table layout adds, unless given."""
    return list(columns or [c for c in visible.columns if c not in _LAYOUT_ONLY])


def facet_rows(visible, columns=None, starts=None):
    """One row per message and facet it belongs to, from a single scan.

    `starts` (facet -> SQL literal) leaves out messages older than their facet's start. The tests run
    on the unpivoted columns, where they stay short.
    """
    carried = _shown(visible, columns)
    labels = {f"_{section}": column for section, column in SECTION_COLUMNS.items()}
    wanted = []
    for section, label in FACETS:
        test = f"_section = '_{section}' AND label = '{label}'"
        since = (starts or {}).get((section, label))
        wanted.append(f"{test} AND dt_stamp >= {since}" if since else test)
    wide = visible.select(*carried, *[F.col(column).alias(name) for name, column in labels.items()])
    flat = wide.unpivot(carried, list(labels), "_section", "label").where(" OR ".join(wanted))
    return flat.select(F.substr("_section", F.lit(2)).alias("section"), "label", *carried)


def _time_literal(visible):
    """An expression that writes a time as SQL of its own type, whatever the zones of driver and session."""
    if isinstance(visible.schema["dt_stamp"].dataType, T.TimestampType):
        return lambda c: F.concat(F.lit("timestamp_micros("), F.unix_micros(c).cast("string"), F.lit(")"))
    return lambda c: F.concat(F.lit("timestamp_ntz'"), F.col(c).cast("string"), F.lit("'"))


def newest(rows, keys, n):
    """The n newest rows per key, ranked; equal times go by id.

    Two rounds. The first keeps n per key within one of a few slices of the input tasks, so no
    task has to take every other task's candidates for a hot key; the second keeps n of those.
    Each round drops rows before its shuffle, and a row among the n newest overall is among
    the n newest of its slice, whichever slice that is.
    """
    order = [F.desc("dt_stamp"), F.desc("id")]
    sliced = rows.withColumn("_slice", F.spark_partition_id() % _SPREAD)
    first = Window.partitionBy(*keys, "_slice").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    candidates = sliced.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)
    return (
        candidates.drop("_slice", "rank")
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= n)
        .withColumn("rank", F.col("rank").cast("long"))
    )


def facet_counters():
    """One count per facet, in the order of FACETS."""
    return [
        F.expr(f"count_if({SECTION_COLUMNS[section]} = '{label}') AS {section}_{label}")
        for section, label in FACETS
    ]


def facet_starts(visible, n=FACET_SIZE, by=()):
    """Per facet (and key), an hour such that n of its messages are at least that new.

    Counters per hour are summed from the newest hour back. Facets with fewer than n messages
    are absent.
    """
    hours = visible.groupBy(*by, F.window("dt_stamp", "1 hour").alias("hour")).agg(*facet_counters())
    counts = as_rows(
        hours,
        [*by, "hour", "section", "label", "found"],
        [
            [*by, "hour.start", f"'{section}'", f"'{label}'", f"{section}_{label}"]
            for section, label in FACETS
        ],
    ).where("found > 0")
    # one row per facet, key and hour
    back = Window.partitionBy(*by, "section", "label").orderBy(F.desc("hour"))
    return (
        counts.withColumn("reached", F.sum("found").over(back)).where(F.col("reached") >= n)
        .groupBy(*by, "section", "label").agg(F.max("hour").alias("since"))
    )


def _recent_rows(visible, n, columns):
    """The facet rows that can be among the n newest of their facet.

    The starts, one per facet, become literals: the scan skips what is older than all of them and
    carries no label of a facet that has fewer than n messages; of the others only the newest
    hours are left to be sorted.
    """
    literal = _time_literal(visible)
    found = facet_starts(visible, n).orderBy("since").select("section", "label", literal("since").alias("since")).collect()
    starts = {(r["section"], r["label"]): r["since"] for r in found}
    if starts:
        short = [f"{SECTION_COLUMNS[s]} = '{v}'" for s, v in FACETS if (s, v) not in starts]
        visible = visible.where(" OR ".join([f"dt_stamp >= {found[0]['since']}", *short]))
    return facet_rows(visible, columns, starts)


def _newest_by(visible, n, by, columns, broadcast_bytes=None):
    """The same per key, in two steps: ranks from keys, times and ids alone, then the winners' columns.

    The winners are at most n per facet and key. Where they fit a broadcast the messages aren't shuffled.
    """
    keys = list(dict.fromkeys([*by, "id", "dt_stamp"]))
    ranked = newest(facet_rows(visible.select(*keys, *SECTION_COLUMNS.values()), keys), [*by, "section", "label"], n)
    winners, small = measured_copy(ranked.select("section", "label", "rank", "id"), broadcast_bytes)
    carried = list(dict.fromkeys([*_shown(visible, columns), *by]))
    rows = visible.select(*carried).join(F.broadcast(winners) if small else winners, "id")
    return rows.select("section", "label", *carried, "rank")


def latest_per_facet(visible, n=FACET_SIZE, by=(), columns=None, broadcast_bytes=None):
    """The n newest messages per facet (and key), newest first as rank 1.

    `columns` of the message (id and dt_stamp among them) limits what is carried along; ids are unique.
    """
    if by:
        return _newest_by(visible, n, list(by), columns, broadcast_bytes)
    return newest(_recent_rows(visible, n, columns), ["section", "label"], n)


def facet_messages(visible, n=FACET_SIZE, columns=None):
    """One row per facet, empty ones included: count and the messages as an array, newest first."""
    message = F.struct("rank", *_shown(visible, columns))
    found = latest_per_facet(visible, n, columns=columns).groupBy("section", "label").agg(
        F.array_sort(F.collect_list(message)).alias("messages")  # at most n rows each
    )
    empty = F.array().cast(found.schema["messages"].dataType)
    return (
        facet_dimension(visible.sparkSession)
        .join(found, ["section", "label"], "left")
        .withColumn("messages", F.coalesce("messages", empty))
        .withColumn("n", F.size("messages").cast("long"))
    )


def facet_nested(visible, n=FACET_SIZE):
    """One row per section: a map from label to its messages."""
    entry = F.struct("position", "label", "messages")
    return facet_messages(visible, n).groupBy("section").agg(
        F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["label"], e["messages"])
        )).alias("breakdown")
    )


def facet_sufficiency(visible, n=FACET_SIZE):
    """Whether each facet has the n messages a summary needs, from counters alone."""
    counts = visible.agg(*facet_counters())
    found = as_rows(counts, ["section", "label", "title", "label_title", "found"], [
        [f"'{section}'", f"'{label}'", f"'{SECTION_TITLES[section]}'", f"'{LABEL_TITLES[label]}'",
         f"least({section}_{label}, {n}L)"]
        for section, label in FACETS
    ])
    return found.selectExpr(
        "section", "label", "title", "found", f"found >= {n} AS sufficient",
        f"CASE WHEN found < {n} THEN concat("
        f"{', '.join(repr(p) if p[0] == ' ' or p[-1] == ' ' else p for p in SHORT_NOTE)}) END AS note",
    )


def corpus_of(facets, n=FACET_SIZE, preamble=PREAMBLE):
    """One prompt text per facet that has n messages."""
    texts = F.transform("messages", lambda m: m["message"])
    return facets.where(F.col("n") >= n).select(
        "section", "label", "n",
        F.concat(F.lit(preamble), F.array_join(texts, "\n")).alias("corpus"),
    )


def facet_corpus(visible, n=FACET_SIZE, preamble=PREAMBLE):
    return corpus_of(facet_messages(visible, n, _TEXT_ONLY), n, preamble)


def key_terms(rows, k=10, keys=("section", "label")):
    """The k most used words per key over whole messages; equal counts go by the word."""
    counts = (
        rows.select(*keys, F.explode(terms("message")).alias("term"))
        .where("term <> ''")
        .groupBy(*keys, "term").agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "term")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("rank", F.col("rank").cast("long"))


def facet_key_terms(visible, n=FACET_SIZE, k=10):
    return key_terms(latest_per_facet(visible, n, columns=_TEXT_ONLY), k)


"""The dashboard as one scan.

All panels but the timeline follow from a table of counters per (sentiment, language), which
holds a few dozen rows whatever the number of messages.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.functions.rounding import percent, tenths_exact, tenths_scaled
from chatlens.functions.text import capitalised, long_enough, named, share_text
from chatlens.operators import metrics, timeline
from chatlens.operators.filters import not_deleted, visible_messages
from chatlens.operators.metrics import as_rows
from chatlens.schema import FLAGS, SENTIMENT_NAMES, STANCES

_KINDS = ["Favor", "Neutral", "Against"]


def label_counters(messages):
    """Backlog and visible messages, counted per sentiment and language in one pass."""
    fits = long_enough(messages)
    shown = F.col("enriched") & fits & not_deleted()
    backlog = ~F.col("enriched") & fits
    return (
        messages.withColumn("shown", shown).where(F.col("shown") | backlog)
        .groupBy("shown", "senti", "lang")
        .agg(
            F.count("*").alias("n"),
            *[F.count_if(f).alias(f) for f in FLAGS],
            *[F.expr(f"count_if({s} = '{k}') AS {s}_{k}") for s in STANCES for k in _KINDS],
        )
    )


def _fixed_items(spark):
    """The items that are shown even where no message counts towards them."""
    items = [("corpus", "enriched"), ("corpus", "not_enriched")]
    items += [(panel, f) for f in FLAGS for panel in ("flag", "flag base")]
    items += [(s, k) for s in STANCES for k in _KINDS]
    return spark.createDataFrame([(*item, 0) for item in items], "panel string, item string, n long")


def merged_counters(counters):
    """Counters of parts of the messages, added up."""
    keys = ["shown", "senti", "lang"]
    return counters.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters.columns if c not in keys])


def dashboard_overview(messages):
    """All count panels as rows: panel, item, n, percentage and display text."""
    return overview_of(label_counters(messages))


def overview_of(counters):
    """The count panels from counters per sentiment and language."""
    rows = [
        ["'corpus'", "if(shown, 'enriched', 'not_enriched')", "n", "true"],
        ["'sentiment'", "sentiment", "n", "shown AND spelling <> 'Na'"],
        ["'language'", "lang", "n", "shown AND lang IS NOT NULL"],
    ]
    for f in FLAGS:  # with the number of messages a flag's share refers to
        rows += [["'flag'", f"'{f}'", f, "shown"], ["'flag base'", f"'{f}'", "n", "shown"]]
    for s in STANCES:
        rows += [[f"'{s}'", f"'{k}'", f"{s}_{k}", "shown"] for k in _KINDS]
    spelling = capitalised("senti")
    counters = counters.withColumns({"spelling": spelling, "sentiment": named(spelling, SENTIMENT_NAMES)})
    panel, count = F.col("panel"), F.col("n")
    items = (
        as_rows(counters, ["panel", "item", "n", "counts"], rows).where("counts").drop("counts")
        .unionByName(_fixed_items(counters.sparkSession))
        .groupBy("panel", "item").agg(F.sum("n").alias("n"))
    )
    is_base = panel == "flag base"
    # over the aggregated items: one small window per panel, and per item for a flag's base
    panel_total = F.sum("n").over(Window.partitionBy("panel"))
    base = F.max(F.when(is_base, count)).over(Window.partitionBy("item"))
    flag_pct = tenths_exact(percent(count, F.col("base")))
    language_pct = tenths_scaled(percent(count, F.col("panel_total")))
    text = (
        F.when(panel == "language", share_text(count, F.col("pct")))
        .when((panel == "flag") & (count == 0), "Not Applicable")
        .when(panel == "flag", share_text(count, F.col("pct"), F.col("base")))
    )
    return (
        items.withColumns({"panel_total": panel_total, "base": base})
        .where(~is_base)
        .withColumn("pct", F.when(panel == "flag", flag_pct).when(panel == "language", language_pct))
        .select("panel", "item", "n", "pct", text.alias("text"))
    )


def panels(messages):
    """Every panel as its own lazy DataFrame."""
    visible = visible_messages(messages)
    return {
        "sentiment": metrics.sentiment_distribution(visible),
        "flags": metrics.flag_rates(visible),
        "stances": metrics.stance_totals(visible),
        "languages": metrics.language_distribution(visible),
        "timeline": timeline.stance_timeline_adaptive(visible),
        "counts": metrics.corpus_counts(messages),
    }

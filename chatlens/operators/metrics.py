"""Dashboard figures over visible messages. Every one is a single aggregating pass."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.functions.rounding import percent, tenths_exact, tenths_scaled
from chatlens.functions.text import capitalised, long_enough, named, share_text
from chatlens.functions.time import minutes_between
from chatlens.operators.filters import not_deleted
from chatlens.schema import FLAGS, SENTIMENT_NAMES, STANCE_TITLES, STANCES


def as_rows(df, names, rows):
    """Turn the columns of an aggregate into rows; each row is a list of SQL expressions."""
    values = ", ".join(", ".join(row) for row in rows)
    return df.selectExpr(f"stack({len(rows)}, {values}) AS ({', '.join(names)})")


def sentiment_distribution(visible):
    """Messages per sentiment; not-applicable and missing are left out, spellings merge."""
    counts = (
        visible.groupBy(capitalised("senti").alias("key")).agg(F.count("*").alias("n"))
        .where(F.col("key") != "Na")
    )
    return counts.select(named("key", SENTIMENT_NAMES).alias("sentiment"), "n").orderBy(F.desc("n"), "sentiment")


def flag_rates(visible):
    """How many messages are trolling, and how many toxic; a missing flag is false."""
    totals = visible.agg(F.count("*").alias("n_total"), *[F.count_if(f).alias(f) for f in FLAGS])
    rates = as_rows(totals, ["flag", "n", "n_total"], [[f"'{f}'", f, "n_total"] for f in FLAGS])
    text = F.when(F.col("n") == 0, "Not Applicable").otherwise(
        share_text(F.col("n"), F.col("pct"), F.col("n_total"))
    )
    return rates.withColumn("pct", tenths_exact(percent("n", "n_total"))).withColumn("text", text)


def stance_totals(visible):
    """Favor, neutral and against counts of each stance, zero where there are none."""
    kinds = ["Favor", "Neutral", "Against"]
    totals = visible.agg(*[
        F.expr(f"count_if({s} = '{kind}') AS {s}_{kind}") for s in STANCES for kind in kinds
    ])
    return as_rows(totals, ["stance", "title", "favor", "neutral", "against"], [
        [f"'{s}'", f"'{STANCE_TITLES[s]}'", *[f"{s}_{kind}" for kind in kinds]] for s in STANCES
    ])


def language_distribution(visible):
    """Messages per language with their share of all messages that have one."""
    counts = visible.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over the few aggregated rows
    pct = tenths_scaled(percent(F.col("n"), total))
    return (
        counts.withColumn("pct", pct)
        .withColumn("text", share_text(F.col("n"), F.col("pct")))
        .orderBy(F.desc("n"), "lang")
    )


def corpus_counts(messages):
    """Backlog and visible messages, counted in one pass."""
    fits = long_enough(messages)
    return messages.agg(
        F.count_if(~F.col("enriched") & fits).alias("not_enriched"),
        F.count_if(F.col("enriched") & fits & not_deleted()).alias("enriched"),
    )


def time_span(visible):
    return visible.agg(F.min("dt_stamp").alias("first_at"), F.max("dt_stamp").alias("last_at")).withColumn(
        "minutes", minutes_between(F.col("first_at"), F.col("last_at"))
    )

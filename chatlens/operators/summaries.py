"""Summaries of facets: a user's text function, or key terms, into appendable records."""

import time

import pandas as pd
from pyspark.sql import functions as F

from chatlens.functions.time import moment
from chatlens.operators.facets import corpus_of, key_terms
from chatlens.schema import FACET_SIZE, FACETS


def summarise(corpus, fn, column="corpus"):
    """Apply fn(text) -> text to each corpus row, on the executors.

    A row holds at most the n messages of one facet, so no grouping is needed; spread the
    rows first if fn is slow (one_a_task). A call that fails fails the run: see try_summaries.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return corpus.withColumn("summary", run(column))


def one_a_task(corpus):
    """Facets dealt to as many tasks as there are facets, so that slow calls run side by side."""
    names = F.array(*[F.lit(f"{section}/{label}") for section, label in FACETS])
    place = F.array_position(names, F.concat_ws("/", "section", "label"))
    return corpus.withColumn("_place", place).repartitionByRange(len(FACETS), "_place").drop("_place")


def try_summaries(corpus, fn, tries=3, wait=1.0, column="corpus"):
    """As summarise, with an outcome for each row: the text, or the error of the last try, and how many were made.

    Between tries the task waits: `wait` seconds, then twice as long each time. Rows without text are not tried.
    """

    def attempt(text):
        error = None
        for n in range(1, tries + 1):
            try:
                return fn(text), None, n
            except Exception as e:  # whatever a user's function raises is the row's outcome
                error = f"{type(e).__name__}: {e}"
                if n < tries:
                    time.sleep(wait * 2 ** (n - 1))
        return None, error, tries

    @F.pandas_udf("summary string, error string, tries int")
    def run(texts: pd.Series) -> pd.DataFrame:
        outcomes = [(None, None, 0) if text is None else attempt(text) for text in texts]
        return pd.DataFrame(outcomes, columns=["summary", "error", "tries"])

    outcome = run.asNondeterministic()(column)
    return corpus.withColumn("_outcome", outcome).select(*corpus.columns, "_outcome.*")


def term_summaries(facets, n=FACET_SIZE, k=5):
    """Model-free summary text: the key terms of every facet that has n messages."""
    rows = facets.where(F.col("n") >= n).select(
        "section", "label", F.explode("messages.message").alias("message")
    )
    ranked = key_terms(rows, k).groupBy("section", "label").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("terms")  # at most k
    )
    return ranked.select("section", "label", F.array_join("terms.term", ", ").alias("summary"))


def model_summaries(facets, fn, n=FACET_SIZE):
    """Summary text by a user's function, for every facet that has n messages."""
    return summarise(one_a_task(corpus_of(facets, n)), fn).select("section", "label", "summary")


def summary_records(facets, summaries, generated_at):
    """One row per facet: its messages and, where there were enough, the summary."""
    return facets.join(summaries, ["section", "label"], "left").select(
        moment(generated_at).alias("generate_dt"), "section", "label", "n", "messages", "summary"
    )


def nested_record(records):
    """One row per run: a map from section to its labels' messages and summaries."""
    per_label = F.struct("label", F.struct("messages", "summary"))
    sections = records.groupBy("generate_dt", "section").agg(
        F.map_from_entries(F.collect_list(per_label)).alias("labels")
    )
    return sections.groupBy("generate_dt").agg(
        F.map_from_entries(F.collect_list(F.struct("section", "labels"))).alias("sections")
    )

"""A summary run and a label correction, end to end."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.facets import facet_corpus, facet_messages
from chatlens.operators.summaries import (
    model_summaries, one_a_task, summary_records, term_summaries, try_summaries,
)
from chatlens.operators.upsert import edit_diff
from chatlens.plans.layout import apply_label_updates
from chatlens.schema import FACET_SIZE, POSITION
from chatlens.session import exists, materialise
from chatlens.streaming.enrichment import log_correction


def summary_run(visible, generated_at, n=FACET_SIZE, fn=None):
    """Facets, the summaries of those that are large enough, and one record per facet.

    The facets (at most n messages each) are written once, as both steps read them.
    fn(text) -> text writes the summaries; without it they list key terms.
    """
    facets = materialise(facet_messages(visible, n), "facets")
    summaries = model_summaries(facets, fn, n) if fn else term_summaries(facets, n)
    return summary_records(facets, summaries, generated_at)


def complete_summaries(spark, visible, path, run, fn, n=FACET_SIZE, tries=3, wait=1.0):
    """Summaries of all facets of a run that are large enough, one row each: text or error, and how often it was tried.

    Outcomes are appended below `path`. A repeated run (by its name) calls fn only for facets that have no text yet;
    their messages are those of the first time.
    """
    folder = f"{path}/run={run}"
    corpus = _kept_corpus(spark, visible, f"{folder}/corpus", n)
    outcomes = f"{folder}/outcomes"
    fields = [*corpus.schema.fields, *_OUTCOME.fields]
    known = spark.read.schema(T.StructType(fields)).parquet(outcomes) if exists(spark, outcomes) else None
    done = known.where("summary IS NOT NULL") if known else None
    todo = corpus.join(done, ["section", "label"], "left_anti") if done else corpus
    made = materialise(try_summaries(one_a_task(todo), fn, tries, wait), "outcomes")
    made.write.mode("append").parquet(outcomes)
    rows = spark.read.schema(T.StructType(fields)).parquet(outcomes)
    return rows.groupBy("section", "label").agg(
        F.max("summary").alias("summary"), F.sum("tries").cast("long").alias("tries"),
        F.when(F.max("summary").isNull(), F.max("error")).alias("error"))


_OUTCOME = T.StructType([
    T.StructField("summary", T.StringType()), T.StructField("error", T.StringType()), T.StructField("tries", T.IntegerType())])


def _kept_corpus(spark, visible, path, n):
    if not exists(spark, path):
        facet_corpus(visible, n).select("section", "label", "corpus").write.parquet(path)
    return spark.read.parquet(path)


def append_summaries(records, path):
    records.write.mode("append").parquet(path)


def correct_labels(spark, path, original, edited, as_of, block_rows=None, log=None, name=None):
    """Write the rows a reviewer changed back to the message table.

    With a label log (its folder) the correction, under a name of its own, takes its place there, after the batches
    written so far: what the log holds from before never overwrites it, what comes later does, whenever it is folded.
    """
    changed = edit_diff(original, edited)
    if log:
        placed = log_correction(spark, log, changed, name, as_of)
        return apply_label_updates(spark, path, placed, order=POSITION, block_rows=block_rows)
    # the comparison must not run against files that the write replaces
    changed = materialise(changed.withColumn("seq", F.lit(0)), "edits")
    return apply_label_updates(spark, path, changed, as_of, block_rows=block_rows)

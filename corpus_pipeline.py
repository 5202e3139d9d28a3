"""A corpus from raw documents to packed sequences: rate, deduplicate, decontaminate, redact, pack.

Each stage takes all documents its predecessor kept and returns those it keeps, with the same columns; the
last one returns the pieces of the packed sequences. Between stages the documents are written as Parquet
in the shared folder and read again, so that a lost executor costs one stage at most.

The stages set how many documents a Python task gets at once (ARROW_ROWS, for the whole session, as their results are
computed when they are written): ten thousand whole texts, Spark's own number, fill much of a small executor.
"""

import functools

import public_tokenizers

from chatlens.llm import decontamination, jaccard, packing, quality, secretscan
from chatlens.session import limit_batches, materialise

TOKENIZER = "word_bpe_49k.json"
ARROW_ROWS = 1000
ORACLE_SQL = None  # a classifier, a forest and a tokenizer are not SQL; tests compare each stage with brute force


def _stage(f):
    @functools.wraps(f)
    def limited(spark, docs, sf_dir):
        limit_batches(spark, ARROW_ROWS)
        return f(spark, docs, sf_dir)
    return limited


@_stage
def rate(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, quality.grade_of(labels)))


@_stage
def deduplicate(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return jaccard.keep_one(docs)


@_stage
def decontaminate(spark, docs, sf_dir):
    """Documents that overlap with a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def redact(spark, docs, sf_dir):
    """Secrets are replaced in the text."""
    return secretscan.redact(docs)


@_stage
def pack(spark, docs, sf_dir):
    """Pieces of packed sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", rate),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("packing", pack),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs

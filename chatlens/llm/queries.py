"""The operators of this subpackage as queries over the given tables."""

import public_tokenizers
from pyspark.sql import functions as F

from chatlens.llm import (
    alignment, decontamination, innerproducts, jaccard, neighbours, packing, periodic, quality, secretscan,
    substrings, suffixes, tokencounts, toxicity,
)

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model)


def op2_substrings(spark, sf_dir):
    return substrings.dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op3_decontamination(spark, sf_dir):
    found = decontamination.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op4_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.nearest(vectors, queries)


def op5_jaccard(spark, sf_dir):
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_quality(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    model = quality.train(documents, quality.grade_of(_table(spark, sf_dir, "labels")))
    return quality.assess(documents, model)


def op8_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_suffixes(spark, sf_dir):
    return suffixes.dedup(_table(spark, sf_dir, "documents"), with_bytes=False)


def op10_secret_scan(spark, sf_dir):
    return secretscan.scan(_table(spark, sf_dir, "documents")).drop("key")


def op11_periodic_runs(spark, sf_dir):
    return periodic.runs(_table(spark, sf_dir, "documents"), planted=True)


def op12_token_alignment(spark, sf_dir):
    return alignment.align(
        _table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op13_inner_products(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return innerproducts.top_inner_products(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substrings": op2_substrings,
    "op3_decontamination": op3_decontamination,
    "op4_neighbours": op4_neighbours,
    "op5_jaccard": op5_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_suffixes": op9_suffixes,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_inner_products": op13_inner_products,
}
ORACLE = {
    "op13_inner_products": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(
                CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
}

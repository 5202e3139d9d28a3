"""Defined cases of earlier operators: schemas that don't follow the data, no labels, mixed lengths, long words."""

import brute
import numpy as np
import public_tokenizers
import pytest

from chatlens.llm import neighbours, quality, secretscan, tokencounts
from chatlens.llm.queries import PIECES


def test_quality_columns_do_not_follow_the_ratings(spark):
    documents = brute.odd(spark)
    want = ["doc_id", "expected_grade", "tail_1", "tail_2", "keep"]
    ratings = [(i, i % 3) for i in range(1, 19)]
    for rows in ([], [(i, min(g, 1)) for i, g in ratings], ratings):
        model = quality.train(documents, spark.createDataFrame(rows, "doc_id long, grade int"))
        got = quality.assess(documents, model)
        assert got.columns == want and got.count() == documents.count()
        tails = {r["tail_2"] for r in got.collect()}
        if len(model["cuts"]) == 0:
            assert tails == {None} and not rows
        else:
            assert (tails == {0.0}) == (len(model["cuts"]) == 1)
        with pytest.raises(ValueError):
            quality.assess(documents, {"cuts": [0.0] * 3})


def test_without_findings_of_both_labels_clean_text_stays(spark):
    clean = [(1, "Order 2024-01-02:17 see https://example.org/path/file_v2.pdf and report2024final.pdf"), (2, "call 0123456789 now"),
             (3, None), (4, "")]
    documents = spark.createDataFrame(clean, "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in secretscan.redact(documents).collect()} == set(clean)
    secret = "AKIA" + "ABCD2345EFGH6789"
    one = spark.createDataFrame([(1, f"key {secret} in file_v2_final.pdf")], "doc_id long, text string")
    assert secretscan.redact(one).first()["text"] == f"key {secretscan.MASK} in file_v2_final.pdf"


def test_queries_of_another_length_than_the_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 4)))]
    rows += [(1000 + 100 * i, [1.0, 2.0, float(i)]) for i in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = neighbours.nearest(table, queries).collect()
    assert {r["query_id"] for r in got} == {0, 100, 200} and len(got) == 30


def test_a_long_word_without_pieces(spark):
    path = public_tokenizers.path(PIECES)
    words = ["\U0010FFFD" * 700, "\U0010FFFD" * 3 + "the" * 40, "ab" * 500]
    scores = tokencounts.piece_scores(path)
    want = [brute.token_count(w, scores, tokencounts.MARK, tokencounts.UNKNOWN_SCORE) for w in words]
    documents = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert [r["n_tokens"] for r in tokencounts.token_counts(documents, path).orderBy("doc_id").collect()] == want
    assert want[0] > 2800

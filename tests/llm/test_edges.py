"""Cases at the edges of the operators' methods: magnitudes, short and punctuated texts, odd secrets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import decontamination, neighbours, secretscan


@pytest.mark.parametrize("norm", ["ten", "mixed", "wide"])
def test_graph_of_any_norm(spark, norm):
    """The rounds improve the graph whatever the length of the vectors."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x *= {"ten": 10.0, "mixed": rng.choice([0.5, 1, 3, 10], (len(x), 1)), "wide": rng.choice([1e-6, 1, 1e6], (len(x), 1))}[norm]
    x = x.astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<float>")
    edges = {(r["u"], r["v"]) for r in neighbours.build_graph(nodes).select("u", "v").collect()}
    hit = []
    for i in range(0, len(x), 10):
        d = ((x.astype(float) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += [(i, int(j)) in edges for j in np.argsort(d)[:10]]
    assert np.mean(hit) >= 0.9


def test_table_of_one_block_is_complete(spark):
    """Every node of a table below one block has an edge to every other."""
    rows = [(i, [float(1 if i % 2 else -1), 0.01 * i]) for i in range(1, 6)]
    for n in (2, 5):
        nodes = spark.createDataFrame(rows[:n], "node long, x array<float>")
        edges = {(r["u"], r["v"]) for r in neighbours.build_graph(nodes).collect()}
        assert edges == {(a, b) for a in range(1, n + 1) for b in range(1, n + 1) if a != b}


def changed(words, places):
    return [f"other{i}" if i in places else w for i, w in enumerate(words)]


@pytest.mark.parametrize("size", range(1, 14))
def test_every_allowed_substitution_leaves_a_seed(size):
    spare = size - math.ceil(size * decontamination.SHARE)
    for places in itertools.combinations(range(size), spare):
        assert any(not set(places) & {s + o for o in mask}
                   for mask in decontamination.masks_for(size) for s in range(size - mask[-1]))


def test_short_items_with_punctuation_at_both_ends(spark):
    """Found with every allowed substitution and no more, alone and inside a document."""
    items, rows, want = [], [], set()
    for size in range(1, 14):
        words = [f"i{size}w{k}" for k in range(size)]
        items.append((size, "¿" + " ".join(words) + "?"))
        spare = size - math.ceil(size * decontamination.SHARE)
        for n in range(spare + 2):
            for places in itertools.combinations(range(size), n):
                text = " ".join(changed(words, places))
                for whole in (text, f"«Before, {text}» after"):
                    rows.append((len(rows), whole))
                    want |= {(len(rows) - 1, size)} if n <= spare else set()
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontamination.overlaps(documents, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_items_in_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "「東京から大阪まで何時間かかりますか」"), (2, "ประเทศไทยมีกี่จังหวัด")], "item_id long, text string")
    documents = spark.createDataFrame(
        [(1, "質問です。東京から大阪まで何時間かかりますか。答え"), (2, "ถามว่าประเทศไทยมีกี่จังหวัดครับ"), (3, "東京は大きい")],
        "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.overlaps(documents, items).collect()} == {(1, 1), (2, 2)}
    assert [r["doc_id"] for r in decontamination.clean(documents, items).collect()] == [3]


def test_secrets_of_any_length_and_characters(spark, small):
    rows = [(5000, "then password=Tr0ub4dor&3 was set", "Tr0ub4dor&3"), (5001, "at postgres://u:p4ss!w0rd@host now", "p4ss!w0rd"),
            (5002, "the secret: correcthorsebattery, he said", "correcthorsebattery"), (5003, "password hunter2.", "hunter2"),
            (5004, 'token = "a1\\Eb2$c3"', "a1\\Eb2$c3")]
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    scanned = {(r["doc_id"], r["candidate"]): r for r in secretscan.scan(df).filter("doc_id >= 5000").collect()}
    assert {(i, c) for i, _, c in rows} <= set(scanned)
    texts = {r["doc_id"]: r["text"] for r in secretscan.redact(df).filter("doc_id >= 5000").collect()}
    for i, text, c in rows:
        assert scanned[i, c]["is_secret"] == (c not in texts[i])
    assert scanned[5000, "Tr0ub4dor&3"]["is_secret"] and texts[5000] == f"then password={secretscan.MASK} was set"
    assert (5000, "was") not in scanned

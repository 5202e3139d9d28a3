"""Dedup, joins, counts and packing against plain versions, on odd tables and given ones."""

import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chatlens.llm import jaccard, packing, substrings, suffixes, superkmers, tokencounts
from chatlens.llm.components import connected_components
from chatlens.llm.queries import PIECES, QUERIES, WORD_BPE


@pytest.fixture(scope="module")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.mark.parametrize("hot", [1000, 1])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmers, "HOT", hot)
    got = substrings.dedup(brute.odd(spark))
    want = brute.removed_words(brute.pairs(brute.odd_rows()))
    assert brute.by_key(got.drop("kept").collect()) == brute.by_key(want)
    assert sum(r[2] for r in want) > 300


def test_substrings_of_given_documents(spark, tiny, documents):
    want = brute.removed_words(brute.pairs(documents.select("doc_id", "text").collect()))
    assert brute.by_key(QUERIES["op2_substrings"](spark, tiny).collect()) == brute.by_key(want)


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(superkmers, "HOT", hot)
    got = suffixes.dedup(brute.odd(spark))
    want = brute.removed_bytes(brute.pairs(brute.odd_rows()))
    assert brute.by_key(got.drop("kept").collect()) == brute.by_key(want)
    assert sum(r[2] for r in want) > 1000


def test_suffixes_of_given_documents(spark, tiny, documents):
    want = brute.removed_bytes(brute.pairs(documents.select("doc_id", "text").collect()))
    assert brute.by_key(QUERIES["op9_suffixes"](spark, tiny).collect()) == brute.by_key(want)


def test_copies_with_repeated_and_missing_ids(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alder", "birch"))
    rows = [(2, one), (2, one), (5, one), (None, one), (None, two), (None, two), (3, f"x {one} y"), (1, one[40:200])]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for operator, plain in ((substrings, brute.removed_words), (suffixes, brute.removed_bytes)):
        got = operator.dedup(documents).drop("kept").collect()
        assert brute.by_key(got) == brute.by_key(plain(brute.pairs(rows)))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(200):
        text = rng.integers(1, rng.choice([2, 3, 6, 60]) + 1, int(rng.integers(1, 300)))
        if trial % 3 == 0:
            text = np.tile(text[:max(1, len(text) // 7)], 7)
        text = np.append(text, 0).astype(np.uint16)
        order = suffixes.suffix_array(text, 10**6)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = suffixes.common_prefixes(text, order, 50)
        for a, b in zip(order, order[1:]):
            x, y = text[a:].tolist(), text[b:].tolist()
            agree = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert shared[b] == min(agree, 50)


def test_jaccard(spark):
    got = jaccard.components(brute.odd(spark))
    assert brute.by_key(got.collect()) == brute.by_key(brute.linked(brute.pairs(brute.odd_rows())))


def test_jaccard_of_given_documents(spark, tiny, documents):
    want = brute.linked(brute.pairs(documents.select("doc_id", "text").collect()))
    assert brute.by_key(QUERIES["op5_jaccard"](spark, tiny).collect()) == brute.by_key(want)


def test_jaccard_finds_links_that_leaders_miss(spark):
    """A chain: each text links with the next one only, so most links join different components late."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i:8 * i + 120])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.by_key(jaccard.components(df).collect()) == brute.by_key(brute.linked(rows))


def test_one_of_each_group_stays(spark):
    df = brute.odd(spark)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    groups = defaultdict(list)
    for row, (_, n, root) in zip(brute.odd_rows(), brute.linked(brute.pairs(brute.odd_rows()))):
        groups[root if n else ("alone", row[4])].append(row)
    want = [min((r for r in g if r[0] is not None), key=lambda r: r[0], default=g[0])[:2] for g in groups.values()]
    assert brute.by_key(r[:2] for r in kept.collect()) == brute.by_key(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 50), (50, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, 50: 50, 200: 50}
    assert got == want


def test_token_counts(spark):
    path = public_tokenizers.path(PIECES)
    scores = tokencounts.piece_scores(path)
    want = []
    for i, text in brute.pairs(brute.odd_rows()):
        words = brute.WORDS.findall(text)
        counts = {w: brute.token_count(w, scores, tokencounts.MARK, tokencounts.UNKNOWN_SCORE) for w in set(words)}
        want.append((i, len(words), sum(counts[w] for w in words)))
    assert brute.by_key(tokencounts.token_counts(brute.odd(spark), path).collect()) == brute.by_key(want)


def check_packing(pieces, texts, tokenizer, length=2048):
    pieces = [r.asDict() for r in pieces]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in texts]
    wanted = defaultdict(list)
    for (i, _), x in zip(texts, ids):
        wanted[i, len(x)].append(x)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    total = sum(map(len, ids))
    assert sum(p["length"] for p in pieces) == total and len(by_sequence) == -(-total // length)
    for sequence, parts in by_sequence.items():
        parts.sort(key=lambda p: p["offset"])
        ends = np.cumsum([0] + [p["length"] for p in parts])
        assert [p["offset"] for p in parts] == ends[:-1].tolist()
        assert ends[-1] == (length if sequence < len(by_sequence) - 1 else total - length * (len(by_sequence) - 1))
        size = int(ends[-1])
        assert {p["padded_length"] for p in parts} == {size if size & (size - 1) == 0 else length}
    for p in pieces:
        crcs = {zlib.crc32(np.array(x[p["start"]:p["start"] + p["length"]], "<u4").tobytes())
                for x in wanted[p["doc_id"], p["doc_tokens"]]}
        assert p["ids_crc32"] in crcs


def test_packing(spark):
    path = public_tokenizers.path(WORD_BPE)
    tokenizer = Tokenizer.from_file(path)
    strange = ["don't 'S O'Neil <|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|", "…!! ≠ ×÷ ÀÉx \x1c 12a3 İ"]
    df = brute.odd(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(strange, 50)), "doc_id long, text string"))
    texts = [*brute.pairs(brute.odd_rows()), *enumerate(strange, 50)]
    check_packing(packing.pack(df, path).collect(), texts, tokenizer)
    check_packing(packing.pack(df, path, 64).collect(), texts, tokenizer, 64)


def test_packing_of_given_documents(spark, tiny, documents):
    texts = brute.pairs(documents.select("doc_id", "text").collect())
    check_packing(QUERIES["op8_packing"](spark, tiny).collect(), texts, Tokenizer.from_file(public_tokenizers.path(WORD_BPE)))


def test_empty_tables(spark):
    nothing = brute.empty(spark)
    assert substrings.dedup(nothing).count() == 0 and suffixes.dedup(nothing).count() == 0
    assert jaccard.components(nothing).count() == 0 and jaccard.keep_one(nothing).columns == nothing.columns
    assert tokencounts.token_counts(nothing, public_tokenizers.path(PIECES)).count() == 0
    assert packing.pack(nothing, public_tokenizers.path(WORD_BPE)).count() == 0


def test_cores_keep_texts_apart_that_share_less_than_a_window():
    """Texts that share 36 bytes, and no window of 50, have no core in common; minimisers of 16 bytes they had."""
    rng = np.random.default_rng(1)
    around = rng.integers(0, 256, (300, 2, 80)).astype(np.uint8)
    texts = np.concatenate([around[:, 0], np.tile(np.frombuffer(b"a passage that stands in every text.", np.uint8), (300, 1)),
                            around[:, 1]], axis=1)
    spec = suffixes.byte_windows()
    document, start, count, minimiser, core, digest = superkmers.super_kmers(
        texts.ravel(), np.arange(301) * texts.shape[1], spec.k, spec.m, spec.t, True)
    assert count.sum() == 300 * (texts.shape[1] - spec.k + 1)
    assert len(np.unique(core)) == len(core) and len(np.unique(minimiser)) < len(np.unique(core))


def test_equal_windows_have_equal_cores():
    text = np.random.default_rng(2).integers(0, 3, 400).astype(np.uint8)
    both, bounds = np.concatenate([text, text[40:300]]), np.array([0, 400, 660])
    for spec in (suffixes.byte_windows(), suffixes.byte_windows(17), suffixes.byte_windows(120)):
        _, start, count, _, core, _ = superkmers.super_kmers(both, bounds, spec.k, spec.m, spec.t, True)
        of_window = {s + i: c for s, n, c in zip(start, count, core) for i in range(n)}
        assert all(of_window[40 + i] == of_window[400 + i] for i in range(260 - spec.k + 1))


def test_lists_move_to_the_texts(spark):
    texts = superkmers.prepared(brute.odd(spark))
    lists = spark.range(40).withColumnRenamed("id", "key").hint("shuffle_hash")
    plan = texts.join(lists, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert texts.count() == len(brute.odd_rows())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chatlens_texts")]


def test_buckets_follow_the_texts(spark, monkeypatch):
    """Few partitions of a large table would be more than a task can hold."""
    monkeypatch.setattr(superkmers, "BUCKET_BYTES", 1 << 12, raising=False)
    rows = [(i, f"{i} " * 400) for i in range(90)]
    texts = superkmers.prepared(spark.createDataFrame(rows, "doc_id long, text string"))
    held = sum(len(t) for _, t in rows) // (1 << 12)
    assert held > 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert held // 2 <= len(texts.inputFiles()) <= held + 1
    assert sorted((r.doc_id, r.text) for r in texts.select("doc_id", "text").collect()) == rows


def joins(df):
    return set(re.findall(r"\w+Join", df._jdf.queryExecution().executedPlan().toString()))


def test_lists_too_long_for_a_hash_table_are_sorted(spark, monkeypatch):
    """A hash table of a bucket's lists cannot spill; the rows are the same by either join."""
    texts = superkmers.prepared(spark.createDataFrame(
        [(i, f"text {i % 30}") for i in range(40)] + [(None, "text"), (41, None)], "doc_id long, text string"))
    key, n = texts.select("key").first()["key"], 1_100_000
    marks = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") == 0, key).otherwise(F.col("id")).alias("key"), F.lit(None).cast("long").alias("doc_id"),
        F.col("id").alias("start"), F.lit(1).cast("long").alias("length"))
    long = superkmers.with_runs(texts, "first < long_id", marks)
    assert joins(long) == {"SortMergeJoin"}
    monkeypatch.setattr(superkmers, "HASHED_BYTES", 1 << 26)
    hashed = superkmers.with_runs(texts, "first < long_id", marks)
    assert joins(hashed) == {"ShuffledHashJoin"}
    assert sorted(map(str, long.collect())) == sorted(map(str, hashed.collect()))
    assert long.count() == 42


def test_dedup_is_the_same_by_sorted_lists(spark, monkeypatch):
    want = sorted(map(str, suffixes.dedup(brute.odd(spark), with_bytes=False).collect()))
    monkeypatch.setattr(superkmers, "LISTED_BYTES", 0)
    monkeypatch.setattr(superkmers, "HASHED_BYTES", 0)
    assert sorted(map(str, suffixes.dedup(brute.odd(spark), with_bytes=False).collect())) == want

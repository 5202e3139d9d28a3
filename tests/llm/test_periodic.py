"""Periodic runs against a plain search for every period."""

import hashlib
import zlib

import brute
import numpy as np
import pytest

from chatlens.llm import periodic
from chatlens.llm.queries import QUERIES


def plain_runs(words, least=2):
    """Every maximal stretch of two periods at least, with its smallest period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((i, n, q) for (i, n), q in best.items())


def plain(doc_id, text, planted):
    words = brute.WORDS.findall(text or "")
    n, checksum = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and checksum % 10 == 0 and n:
        g = checksum // 10
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % q] for i in range(a, n)]
    runs = sorted(plain_runs(words, 12), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    s, m, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, n, len(runs), s, m, q, None if m is None else 1000 * m // q, len(gone),
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def strings():
    rng = np.random.default_rng(3)
    yield from ([], [0], [0] * 40, fibonacci(400), [bin(i).count("1") % 2 for i in range(600)])
    for _ in range(60):
        unit = rng.integers(0, 3, rng.integers(1, 9)).tolist()
        yield rng.integers(0, rng.integers(1, 4), rng.integers(0, 120)).tolist()
        yield (unit * rng.integers(1, 20) + unit[::-1] * rng.integers(1, 20)) * rng.integers(1, 4)
        yield (unit * 12 + [7]) * rng.integers(1, 8) + unit * 5
        out = unit
        for _ in range(3):
            out = (out * rng.integers(1, 6) + rng.integers(0, 3, rng.integers(0, 3)).tolist())[:400]
        yield out


def test_every_run_of_odd_strings():
    all_strings = list(strings())
    symbols = np.concatenate([np.array(s, np.int64) for s in all_strings])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in all_strings])])
    got = sorted(zip(*[x.tolist() for x in periodic.find_runs(symbols, bounds)]))
    assert got == sorted((low + s, n, q) for low, text in zip(bounds.tolist(), all_strings) for s, n, q in plain_runs(text))
    assert len(got) > 5000


def test_a_region_without_positions_proposes_by_its_ends():
    """Long runs of one period that meet: all their periods are found from the meeting alone."""
    for q, m in ((1, 200), (2, 90), (3, 70)):
        unit = list(range(q))
        text = unit * m + unit[1:] + [9] + unit * m + unit[::-1] * m
        symbols = np.array(text, np.int64)
        got = sorted(zip(*[x.tolist() for x in periodic.find_runs(symbols, np.array([0, len(text)]))]))
        assert got == plain_runs(text)


def test_hashes_that_deceive_are_noticed(monkeypatch):
    """Equal hashes for different symbols give runs that don't hold; other hashes are taken then."""
    honest, seeds = periodic._Text.__init__, []

    def poor(self, symbols, longest, seed):
        seeds.append(seed)
        honest(self, np.zeros_like(symbols) if seed == 0 else symbols, longest, seed)

    monkeypatch.setattr(periodic._Text, "__init__", poor)
    text = np.array([i % 7 for i in range(60)] + list(range(10, 100)), np.int64)
    got = sorted(zip(*[x.tolist() for x in periodic.find_runs(text, np.array([0, len(text)]))]))
    assert got == plain_runs(text.tolist()) == [(0, 60, 7)] and seeds == [0, 1]


@pytest.mark.parametrize("planted", [False, True])
def test_odd_rows(spark, planted):
    rows = [(i, t) for i, t, *_ in brute.odd_rows()] + [(i, " ".join("abcdefghij"[k % 7] + str(k // 70) for k in range(90))) for i in range(100, 160)]
    got = periodic.runs(spark.createDataFrame(rows, "doc_id long, text string"), planted).collect()
    assert brute.by_key(got) == brute.by_key(plain(i, t, planted) for i, t in rows)
    odd = periodic.runs(brute.odd(spark), planted)
    assert odd.columns[0] == "doc_id" and odd.count() == len(brute.odd_rows())
    assert periodic.runs(brute.empty(spark)).count() == 0


def test_given_documents(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").where("n_chars < 8000").collect()
    got = QUERIES["op11_periodic_runs"](spark, tiny).collect()
    want = {r[0]: plain(*r, True) for r in rows}
    assert {r[0]: tuple(r) for r in got if r[0] in want} == want and len(got) >= len(rows)


def test_very_long_texts_and_text_ids(spark):
    unit = [f"w{i}" for i in range(1500)]
    rows = [("many words", " ".join(unit * 400 + ["end"])), ("one word", "x" * 5_000_000), ("blank", " " * 3_000_000)]
    got = {r["doc_id"]: r for r in periodic.runs(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert (got["many words"]["start"], got["many words"]["length"], got["many words"]["period"]) == (0, 600_000, 1500)
    assert got["many words"]["n_dropped"] == 598_500 and got["many words"]["exponent_milli"] == 400_000
    assert got["one word"]["n_words"] == 1 and got["one word"]["n_runs"] == got["blank"]["n_words"] == 0
    assert periodic.listed_runs(spark.createDataFrame(rows, "doc_id string, text string")).collect() == [("many words", 0, 600_000, 1500)]

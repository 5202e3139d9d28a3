"""What a Python worker keeps of the tasks it has done."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from chatlens.llm import flat, quality, workers

REPO = Path(__file__).resolve().parents[2]
PLAIN_TASKS = """
import collections, re
import numpy as np, pyarrow as pa
from chatlens.llm import jaccard, quality

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def texts(seed, n=1000, words=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 50_000, words)) for _ in range(n)]

def batches(columns, seeds):
    for seed in seeds:
        yield pa.record_batch([*[pa.array(range(1000))] * (len(columns) - 1), pa.array(texts(seed))], columns)

def work(seeds):
    collections.deque(quality._featurise(batches(["turn", "grade", "text"], seeds)), 0)
    collections.deque(jaccard._summaries(batches(["doc_id", "key", "text"], seeds)), 0)

before = resident()
work(range(4))
print(round(resident() - before))
"""


def test_a_worker_keeps_little_of_a_task():
    said = subprocess.run([sys.executable, "-c", PLAIN_TASKS], cwd=REPO, capture_output=True, text=True, check=True)
    assert int(said.stdout) < 90


def test_memory_is_given_back_however_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append(1))

    @workers.thrifty
    def task(batches):
        for x in batches:
            yield 1 // x

    assert list(task(iter([1, 1]))) == [1, 1] and len(calls) == 1
    with pytest.raises(ZeroDivisionError):
        list(task(iter([0])))
    assert len(calls) == 2
    early = task(iter([1, 1]))
    next(early)
    early.close()
    assert len(calls) == 3


def test_features_are_made_in_small_slices():
    rng = np.random.default_rng(0)
    rows = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 600)) for _ in range(1200)]
    batch = pa.record_batch([pa.array(range(1200)), pa.array([1] * 1200), pa.array(rows)], ["turn", "grade", "text"])
    assert batch.nbytes > 3 << 20
    flat.rolling.cache_clear()
    tracemalloc.start()
    found = sum(x.num_rows for x in quality._featurise([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1200 and most < 60e6

"""What a Python task of the pipeline and of the super-k-mer search holds and does at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from chatlens.llm import flat, jaccard, suffixes, superkmers
from chatlens.session import limit_batches, small_batches

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts(n, words, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{x}" for x in rng.integers(0, 50_000, words)) for _ in range(n)]


def rows_at_once(spark, n=3000):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
    return max(r.n for r in spark.range(0, n, 1, 1).mapInArrow(sizes, "n long").collect())


def test_batches_are_small_while_it_is_asked_for(spark):
    before = spark.conf.get(SETTING, None)
    with small_batches(spark, 500):
        assert rows_at_once(spark) <= 500
        limit_batches(spark, 800)  # never more than before
        assert rows_at_once(spark) <= 500
    assert spark.conf.get(SETTING, None) == before


def test_every_stage_of_the_pipeline_limits_its_batches(spark, tiny):
    documents = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[3:]:  # these two need no other table
        with small_batches(spark, 5000):
            stage(spark, documents, tiny)
            assert int(spark.conf.get(SETTING)) <= corpus_pipeline.ARROW_ROWS, name
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_a_jaccard_task_holds_little_beside_its_batch():
    rows = texts(1200, 600)
    batch = pa.record_batch([pa.array(range(1200)), pa.array(range(1200)), pa.array(rows)], ["doc_id", "key", "text"])
    assert batch.nbytes > 3 << 20
    flat.rolling.cache_clear()
    tracemalloc.start()
    for _ in jaccard._summaries([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


def test_powers_are_kept_no_longer_than_needed():
    roller = flat.Rolling(1)
    n = (1 << 21) + 1
    powers = roller.powers(n, roller.base)
    assert len(roller._powers[roller.base]) <= n + (1 << 16)
    assert powers[n - 1] == pow(roller.base, n - 1, 1 << 64)


def test_digests_are_only_taken_of_wanted_cores():
    data, offsets = flat.byte_array(pa.array(texts(30, 100)))
    every = superkmers.super_kmers(data, offsets, 50, 30, 9, True)
    wanted = np.unique(every[4])[::7]
    some = superkmers.super_kmers(
        data, offsets, 50, 30, 9, True, keep_cores=lambda document, core: np.isin(core, wanted))
    kept = np.isin(every[4], wanted)
    for x, y in zip(every, some):
        assert np.array_equal(x[kept], y)


def test_anchors_of_blocks_are_those_of_the_slice():
    rows = texts(80, 500, seed=1)
    rows = ["", "short", None, *rows, rows[3], rows[5][:300] + rows[6][:300]]
    spec = suffixes.byte_windows()
    data, offsets = flat.byte_array(pa.array(rows))
    assert len(data) > 2 * superkmers._BLOCK
    document, _, _, minimiser = superkmers.super_kmers(data, offsets, spec.k, spec.m, spec.t)
    pairs = sorted(set(zip(document.tolist(), minimiser.tolist())))
    holders = {}
    for d, m in pairs:
        holders.setdefault(m, set()).add(d)
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], ["key", "text"])
    found = pa.Table.from_batches(superkmers._anchors(spec)([batch])).to_pylist()
    assert sorted((r["key"], r["minimiser"]) for r in found if r["key"] is not None) == pairs
    assert all(r["known"] == (len(holders[r["minimiser"]]) > 1) for r in found if r["key"] is not None)
    assert sorted(r["minimiser"] for r in found if r["key"] is None) == sorted(m for m, h in holders.items() if len(h) > 1)

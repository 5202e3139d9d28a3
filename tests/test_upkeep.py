"""Deletes without rewriting, reset, rejects on a stream, summary calls that fail."""

import glob
import json
import os

import pytest
from compare import rows_of_spark
from pyspark.sql import functions as F
from rows import messages, registry, urls

from chatlens.operators import registry as reg
from chatlens.operators import summaries
from chatlens.operators.facets import corpus_of, facet_messages
from chatlens.plans import deletions, layout
from chatlens.plans.runs import complete_summaries
from chatlens.schema import FACETS, SECTION_COLUMNS
from chatlens.sources.tables import stream_lines, stream_messages
from chatlens.streaming import ingest, lines


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


@pytest.mark.parametrize("bound", [None, 0])
def test_a_delete_touches_no_message_file(spark, tmp_path, bound):
    path = str(tmp_path / "table")
    rows = messages(spark, *[{"vid_id": f"v{i % 4}", "delete": i == 3 or None} for i in range(40)])
    layout.append_messages(rows, path, block_rows=5)
    before, gone = files(path), urls(spark, "u?v=v1", "u?v=v2", "u?v=none", "nokey")
    for _ in range(2):
        deletions.delete_videos(spark, path, gone)
    layout.append_messages(messages(spark, {"id": 41, "vid_id": "v1"}), path)
    assert {f: t for f, t in files(path).items() if f in before} == before
    written = sum(os.path.getsize(f) for f in glob.glob(f"{path}_deleted/*/*.parquet"))
    assert written < 20_000
    table = layout.read_table(spark, path)
    want = rows_of_spark(reg.soft_delete(table.where("id <= 40"), gone).unionByName(table.where("id = 41")))
    deleted = deletions.deletions(spark, path)
    assert rows_of_spark(deletions.marked(table, deleted, bound)) == want == rows_of_spark(deletions.read_marked(spark, path))
    assert {r["id"] for r in deletions.shown(table, deleted, bound).collect()} == {
        i + 1 for i in range(40) if i % 4 in (0, 3) and i != 3} | {41}
    deletions.fold_deletions(spark, path)
    changed = {f for f, t in files(path).items() if before.get(f) != t}
    assert rows_of_spark(layout.read_table(spark, path)) == want and changed
    assert deletions.deletions(spark, path).count() == 0
    folded = files(path)
    deletions.fold_deletions(spark, path)
    assert files(path) == folded


def test_reset_is_guarded_and_complete(spark, tmp_path):
    path, listed, root = (str(tmp_path / n) for n in ("table", "registry", "store"))
    layout.append_messages(messages(spark, {}, {}), path, block_rows=1)
    registry(spark, ("u", "YouTube", "start")).write.parquet(listed)
    ingest.know_stored(layout.read_table(spark, path), root)
    deletions.delete_videos(spark, path, urls(spark, "u?v=v1"))
    with pytest.raises(ValueError):
        layout.reset_store(spark, path, listed, [path], root)
    assert layout.read_table(spark, path).count() == 2 and spark.read.parquet(listed).count() == 1
    layout.reset_store(spark, path, listed, [path, listed], root)
    assert layout.read_table(spark, path).count() == 0 == spark.read.parquet(listed).count()
    layout.append_messages(messages(spark, {}, {}, {}), path, block_rows=2)
    assert layout.read_table(spark, path).count() == 3 and deletions.deletions(spark, path).count() == 0
    ingest.land_batch(messages(spark, {"msg_id": "m1"}), 0, root)
    assert ingest.landed_messages(spark, root).first()["id"] == 1


def test_stream_counts_add_up(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))
    os.makedirs(source)

    def line(**fields):
        return json.dumps({"vid_id": "v", "message": "text", "dt_stamp": "2024-03-01T12:00:00", **fields})

    first = [line(msg_id="a"), line(msg_id="a"), line(msg_id="old"), '{"id": 2, "vid_id"', "", "   ", line(), "no json at all"]
    second = [line(msg_id="b", dt_stamp="never"), line(msg_id="a"), '{"msg_id": "c"', line(msg_id=None)]
    for name, texts in (("1.json", first), ("2.json", second)):
        with open(f"{source}/{name}", "w") as f:
            f.write("\n".join(texts) + "\n")
        stream = stream_lines(spark, source, files_per_batch=1)
        lines.stream_ingest_lines(stream, messages(spark, {"id": 7, "msg_id": "old"}), root, checkpoint, available_now=True).awaitTermination()
    counts = lines.line_counts(spark, root).first().asDict()
    assert counts == {"received": 10, "landed": 2, "repeated": 3, "rejected": 5}
    rejected = lines.rejected_messages(spark, root).collect()
    assert sorted((r["batch"], r["reason"]) for r in rejected) == [
        (0, "no JSON"), (0, "no JSON"), (0, "no msg_id"), (1, "no JSON"), (1, "no msg_id")]
    assert '{"id": 2, "vid_id"' in {r["line"] for r in rejected}
    assert {(r["msg_id"], r["id"], r["dt_stamp"] is None) for r in ingest.landed_messages(spark, root).collect()} == {
        ("a", 8, False), ("b", 9, True)}
    plain = stream_messages(spark, source, "json").writeStream.format("memory").queryName("plain_lines").trigger(availableNow=True)
    plain.start().awaitTermination()
    assert spark.table("plain_lines").count() == 7  # no row of NULLs for a broken line


def facet_rows(spark, n):
    """n messages for every facet."""
    return messages(spark, *[{SECTION_COLUMNS[s]: v, "message": f"{s} {v} {k}"} for s, v in FACETS for k in range(n)])


def test_one_facet_a_task(spark):
    corpus = corpus_of(facet_messages(facet_rows(spark, 2), 2), 2)
    per_task = summaries.one_a_task(corpus).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == len(FACETS) and {r["count"] for r in per_task} == {1}


def test_calls_that_fail(spark, tmp_path):
    """One facet fails twice and then works, one always fails; a repeated run calls only the missing one."""
    calls = tmp_path / "calls"
    os.makedirs(calls)

    def count(name):
        with open(calls / name, "a") as f:
            f.write("x")
        return os.path.getsize(calls / name)

    def fn(text, broken=True):
        name = "mil" if "military Favor" in text else "senti" if "sentiment Pos" in text else "rest"
        made = count(name)
        if name == "mil" and made <= 2 or name == "senti" and broken:
            raise RuntimeError(f"call {made}")
        return text[:10]

    visible, path = facet_rows(spark, 2), str(tmp_path / "runs")
    rows = {(r["section"], r["label"]): r for r in complete_summaries(spark, visible, path, "r1", fn, 2, 3, 0.01).collect()}
    assert len(rows) == len(FACETS) and sum(r["summary"] is not None for r in rows.values()) == len(FACETS) - 1
    assert rows["military", "Favor"]["tries"] == 3 and rows["military", "Favor"]["error"] is None
    assert rows["sentiment", "Pos"]["error"] == "RuntimeError: call 3"
    rest = os.path.getsize(calls / "rest")
    again = complete_summaries(spark, visible.limit(0), path, "r1", lambda t: fn(t, broken=False), 2, 3, 0.01).collect()
    assert all(r["summary"] and r["error"] is None for r in again) and len(again) == len(FACETS)
    assert os.path.getsize(calls / "rest") == rest == len(FACETS) - 2 and os.path.getsize(calls / "senti") == 4

"""Live panels, ingest and the upkeep of stored tables as queries: each feeds its data as several micro-batches."""

from functools import reduce

from pyspark.sql import functions as F

from chatlens.operators import filters, summaries
from chatlens.operators import registry as reg
from chatlens.plans import deletions, layout
from chatlens.plans.runs import complete_summaries, correct_labels, summary_run
from chatlens.plans.store import append_unique
from chatlens.schema import MESSAGES, REGISTRY
from chatlens.session import materialise, scratch_path
from chatlens.sources import derived
from chatlens.sources.tables import stream_lines, stream_messages
from chatlens.streaming import enrichment, ingest, lines, panels
from chatlens.streaming.batches import entries
from chatlens.streaming.late import LateTimeline

AS_OF = "2024-02-01 00:00:00"
BLOCK = 5_000
BLOCKS = 100
LINE_BATCHES = 2
PARTS = 3
LATE_AFTER = "10 days"


def _fed(spark, parts, start):
    """Write one part after another below a folder, each by all tasks, and let a stream, start(stream, checkpoint), consume
    it; without a bound on files the new ones are one micro-batch."""
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "offsets")
    for part in parts:
        part.write.mode("append").parquet(source)
        start(stream_messages(spark, source, schema=part.schema), checkpoint).awaitTermination()


def _thirds(rows):
    return [rows.where(F.col("id") % PARTS == k) for k in range(PARTS)]


def _block_rows(messages):
    """BLOCK, or more where a table of the messages would have over BLOCKS folders: each is listed, opened and moved by
    every write."""
    return max(BLOCK, -(-messages.count() // BLOCKS))


def _table(spark, messages):
    path = scratch_path(spark, "table")
    layout.append_messages(messages, path, block_rows=_block_rows(messages))
    return path


def stream_label_folds(spark, sf):
    """Three batches of labels and a reviewer's correction after the second, folded out of order and twice."""
    live, feed = derived.live(spark, sf), derived.label_updates(spark, sf)
    path, root = _table(spark, live), scratch_path(spark, "labels")
    source, checkpoint = scratch_path(spark, "source"), scratch_path(spark, "offsets")

    def log(part):
        feed.where(part).write.mode("append").parquet(source)
        stream = stream_messages(spark, source, schema=feed.schema)
        enrichment.stream_label_updates(
            stream, root, checkpoint, derived.UPDATE_ORDER, AS_OF, available_now=True).awaitTermination()

    log("seq <= 2")
    log("seq BETWEEN 3 AND 4")
    so_far = enrichment.logged_updates(spark, root, feed.schema)
    seen = materialise(enrichment.current_messages(layout.read_table(spark, path), so_far), "seen")  # folds rewrite the table
    enrichment.fold_updates(spark, path, so_far.where("label_batch = 1"))
    correct_labels(spark, path, seen, derived.reviewed(seen), AS_OF, log=root, name="review")
    enrichment.fold_updates(spark, path, so_far)
    log("seq > 4")
    enrichment.fold_log(spark, path, root, feed.schema)
    enrichment.fold_updates(spark, path, so_far)
    return layout.read_table(spark, path).select(*live.columns, "dt_enriched")


def stream_ingest_fold(spark, sf):
    """All messages in three deliveries, each twice and after those before, folded into the table on the way."""
    live = derived.live(spark, sf)
    root, path = scratch_path(spark, "store"), scratch_path(spark, "table")
    nothing = spark.createDataFrame([], MESSAGES)
    thirds, done, block_rows = _thirds(live), [], _block_rows(live)

    def start(stream, checkpoint):
        query = ingest.stream_ingest(stream, nothing, root, checkpoint, available_now=True)
        query.awaitTermination()
        done.append(1)
        if len(done) > 1:
            ingest.fold_landed(spark, root, path, block_rows)
        return query

    _fed(spark, [reduce(lambda a, b: a.unionByName(b), [*thirds[:k + 1], thirds[k]]) for k in range(PARTS)], start)
    return layout.read_table(spark, path).select(*ingest.LANDED.names)


def append_rejects(spark, sf):
    """What a second write of stored messages, new ones and later copies of those refuses."""
    root, path = scratch_path(spark, "store"), scratch_path(spark, "table")
    append_unique(derived.live(spark, sf), path, root)
    number = "CASE WHEN arrival < 0 THEN arrival + 1000000000000000 ELSE 1000000000 + bigint(split(msg_id, '-')[1]) * 100"
    batch = derived.incoming(spark, sf).withColumn("id", F.expr(f"{number} + bigint(split(msg_id, '-')[2]) END"))
    return append_unique(batch, path, root).select("id", "msg_id", "reason")


def _live_panel(summary):
    def query(spark, sf):
        live, root = derived.live(spark, sf), scratch_path(spark, "panels")
        kept = {"panel": summary}
        _fed(spark, _thirds(live), lambda stream, checkpoint: panels.stream_panels(
            stream, root, checkpoint, kept, available_now=True))
        return panels.live_panel(live, root, "panel", summary)
    return query


def _late(spark, sf):
    visible = filters.visible_messages(derived.live(spark, sf))
    line = LateTimeline(visible, scratch_path(spark, "late"), delay=LATE_AFTER)
    _fed(spark, _thirds(visible), lambda stream, checkpoint: line.start(stream, checkpoint, available_now=True))
    return line


def late_messages(spark, sf):
    return _late(spark, sf).late_messages().select("id", "dt_stamp", "batch")


def late_counts(spark, sf):
    return _late(spark, sf).late_counts()


def late_repaired_timeline(spark, sf):
    return _late(spark, sf).repaired()


def _deleted(spark, sf):
    """The older half stored, videos deleted, then the newer half stored."""
    live = derived.live(spark, sf)
    half = live.agg(F.max("id")).first()[0] // 2
    path = _table(spark, live.where(F.col("id") <= half))
    deletions.delete_videos(spark, path, derived.drop_list(spark, sf))
    layout.append_messages(live.where(F.col("id") > half), path)
    return path, live.columns


def deletions_on_read(spark, sf):
    path, columns = _deleted(spark, sf)
    return deletions.read_marked(spark, path).select(*columns)


def deletions_folded(spark, sf):
    path, columns = _deleted(spark, sf)
    for _ in range(2):
        deletions.fold_deletions(spark, path)
    return layout.read_table(spark, path).select(*columns)


def facet_summary_outcomes(spark, sf):
    """A function that fails on facets of odd length, then one that works: only the failed ones are called again."""
    def sometimes(text):
        if len(text) % 2:
            raise RuntimeError("odd length")
        return f"{len(text)} characters"

    visible, path = filters.visible_messages(derived.docmsg(spark, sf)), scratch_path(spark, "outcomes")
    complete_summaries(spark, visible, path, "first", sometimes, tries=2, wait=0.0)
    return complete_summaries(spark, visible, path, "first", lambda text: f"{len(text)} characters", tries=2, wait=0.0)


def _lines(spark, sf):
    """`live` as lines, a broken line for every tenth, every seventh without its key, every third again."""
    live = derived.live(spark, sf)
    line = F.to_json(F.struct(*live.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value")
    broken = live.where("id % 10 = 0").select(F.concat(F.lit('{"id": '), "id", F.lit(', "vid_id"')).alias("value"))
    unnamed = live.where("id % 7 = 0").withColumn("msg_id", F.lit(None).cast("string")).select(line)
    source, root = scratch_path(spark, "lines"), scratch_path(spark, "store")
    texts = [live.select(line), broken, unnamed, live.where("id % 3 = 0").select(line)]
    reduce(lambda a, b: a.unionByName(b), texts).write.text(source)
    files = sum(p.getName().startswith("part-") for p in entries(spark, source)[1])
    lines.stream_ingest_lines(
        stream_lines(spark, source, files_per_batch=-(-files // LINE_BATCHES)), spark.createDataFrame([], MESSAGES), root,
        scratch_path(spark, "offsets"), available_now=True).awaitTermination()
    return root


def stream_line_counts(spark, sf):
    return lines.line_counts(spark, _lines(spark, sf))


def stream_line_rejects(spark, sf):
    rejected = lines.rejected_messages(spark, _lines(spark, sf))
    return rejected.select("reason", F.expr("CASE WHEN reason = 'no JSON' THEN line ELSE get_json_object(line, '$.id') END AS shown"))


def store_reset(spark, sf):
    """Rows of messages and registry: filled, cleared in one step, filled again with every second message."""
    live, path, listed = derived.live(spark, sf), scratch_path(spark, "table"), scratch_path(spark, "registry")

    def counted(step):
        held = layout.read_table(spark, path).agg(F.count("*").alias("messages"))
        urls = spark.read.schema(REGISTRY).parquet(listed).agg(F.count("*").alias("urls"))
        return spark.createDataFrame([(step, held.first()["messages"], urls.first()["urls"])], "step string, messages long, urls long")

    layout.append_messages(live, path, _block_rows(live))
    derived.registry(spark, sf).write.parquet(listed)
    steps = [counted("filled")]
    layout.reset_store(spark, path, listed, [path, listed])
    steps.append(counted("cleared"))
    layout.append_messages(live.where("id % 2 = 0"), path, _block_rows(live))
    return reduce(lambda a, b: a.unionByName(b), [*steps, counted("filled again")])


def summary_nested(spark, sf):
    """The nested record of a run, taken apart again."""
    run = summary_run(filters.visible_messages(derived.docmsg(spark, sf)), AS_OF)
    nested = summaries.nested_record(run)
    sections = nested.select("generate_dt", F.explode("sections").alias("section", "labels"))
    labels = sections.select("generate_dt", "section", F.explode("labels").alias("label", "kept"))
    return labels.select("generate_dt", "section", "label", F.size("kept.messages").cast("long").alias("n"), "kept.summary")


def registry_upsert_ordered(spark, sf):
    """Of several platforms given for a URL the last one wins."""
    known = derived.registry(spark, sf).select("url", F.lit("Archive").alias("platform"), F.lit(1).cast("long").alias("at"))
    pages = derived.table(spark, sf, "pages").selectExpr(
        "url", "CASE WHEN page_id % 2 = 0 THEN 'Web' ELSE 'Blog' END AS platform", "page_id AS at")
    again = known.withColumns({"platform": F.lit("YouTube"), "at": F.lit(2).cast("long")})
    given = known.unionByName(again).unionByName(pages)
    return reg.registry_upsert(derived.registry(spark, sf), given, order=["at"])


QUERIES = {
    "stream_label_folds": stream_label_folds,
    "stream_ingest_fold": stream_ingest_fold,
    "append_rejects": append_rejects,
    "stream_overview": _live_panel(panels.overview()),
    "stream_latest_per_facet": _live_panel(panels.latest_messages()),
    "stream_timeline_adaptive": _live_panel(panels.adaptive_timeline()),
    "stream_timeline_by_video": _live_panel(panels.adaptive_timeline(["vid_id"])),
    "late_messages": late_messages,
    "late_counts": late_counts,
    "late_repaired_timeline": late_repaired_timeline,
    "deletions_on_read": deletions_on_read,
    "deletions_folded": deletions_folded,
    "facet_summary_outcomes": facet_summary_outcomes,
    "stream_line_counts": stream_line_counts,
    "stream_line_rejects": stream_line_rejects,
    "store_reset": store_reset,
    "summary_nested": summary_nested,
    "registry_upsert_ordered": registry_upsert_ordered,
}

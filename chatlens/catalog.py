"""Every operator as a query over the given tables."""

from pyspark.sql import functions as F

from chatlens.catalog_streams import QUERIES as STREAM_QUERIES
from chatlens.functions.text import video_key
from chatlens.functions.time import lenient_timestamp, local_clock
from chatlens.operators import facets, filters, ingest, metrics, projections, quality, summaries, timeline
from chatlens.operators import registry as reg
from chatlens.operators import upsert
from chatlens.plans.dashboard import dashboard_overview
from chatlens.plans.layout import append_messages, apply_label_updates, apply_soft_delete, read_table
from chatlens.plans.runs import append_summaries, correct_labels, summary_run
from chatlens.schema import MESSAGES
from chatlens.session import scratch_path
from chatlens.sources import derived
from chatlens.sources.tables import legacy_frame, read_messages, registry_listing, rejected_lines
from chatlens.streaming import enrichment as stream_labels
from chatlens.streaming import ingest as stream_in
from chatlens.streaming import timeline as stream_time

AS_OF = "2024-02-01 00:00:00"
BACKLOG_BATCH = 100
STORED_BLOCK = 5_000


def _on_live(operator):
    return lambda spark, sf: operator(derived.live(spark, sf))


def _on_visible(operator, source=derived.live):
    return lambda spark, sf: operator(filters.visible_messages(source(spark, sf)))


def _on_registry(operator):
    return lambda spark, sf: operator(derived.registry(spark, sf))


def _all_urls(spark, sf):
    """Every URL anybody knows: the registry's and the pages'."""
    return derived.registry(spark, sf).select("url").unionByName(derived.page_urls(spark, sf))


def url_video_key(spark, sf):
    return derived.page_urls(spark, sf).select("url", video_key("url").alias("video_key"))


def select_by_key(spark, sf):
    active = filters.active_urls(derived.registry(spark, sf)).select(video_key("url").alias("vid_id"))
    return filters.select_by_key(derived.live(spark, sf), active, "vid_id").select("id", "vid_id", "message")


def edit_payload(spark, sf):
    return projections.stored_labels(projections.editor_messages(derived.edited(spark, sf)))


def legacy_messages(spark, sf):
    positional = derived.live(spark, sf).select(
        "id", "vid_id", "author", "author_id", "dt_stamp", "msg_id", "message", "enriched",
        "societal_impact", "sg", "mil", "rnr", "lang", "troll", "toxic", "senti",
    )
    return legacy_frame(positional)


def lenient_timestamps(spark, sf):
    texts = derived.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("string").alias("full"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), F.col("props").alias("junk"),
    )
    return texts.select("event_id", *[lenient_timestamp(c).alias(c) for c in ("full", "day", "junk")])


def clock(spark, sf):
    events = derived.table(spark, sf, "events")
    return events.select("event_id", local_clock(F.col("ts")).alias("clock"))


def _spelled(messages, kind):
    """Whole messages as structs of text, which every engine spells alike."""
    return F.transform(messages, lambda m: F.struct(*[m[f.name].cast("string").alias(f.name) for f in kind.fields]))


def facet_nested(spark, sf):
    nested = facets.facet_nested(filters.visible_messages(derived.live(spark, sf)))
    kind = nested.schema["breakdown"].dataType.valueType.elementType
    shown = F.transform_values("breakdown", lambda _, messages: _spelled(messages, kind))
    return nested.select("section", F.to_json(shown, {"ignoreNullFields": "false"}).alias("breakdown"))


def latest_per_facet_zoned(spark, sf):
    """Times with a zone; shown without it, so that results compare."""
    visible = filters.visible_messages(derived.live(spark, sf))
    latest = facets.latest_per_facet(visible.withColumn("dt_stamp", F.col("dt_stamp").cast("timestamp")))
    return latest.withColumn("dt_stamp", F.col("dt_stamp").cast("timestamp_ntz"))


def facet_summaries(spark, sf):
    """A user's summary function on the executors; here it reports the length of the text."""
    corpus = facets.facet_corpus(filters.visible_messages(derived.docmsg(spark, sf)))
    described = summaries.summarise(corpus, lambda text: f"{len(text)} characters")
    return described.select("section", "label", "n", "summary")


def summary_records(spark, sf):
    visible = filters.visible_messages(derived.docmsg(spark, sf))
    path = scratch_path(spark, "summaries")
    append_summaries(summary_run(visible, AS_OF), path)
    records = spark.read.parquet(path)
    messages = _spelled("messages", records.schema["messages"].dataType.elementType)
    return records.select(
        "generate_dt", "section", "label", "n",
        F.to_json(messages, {"ignoreNullFields": "false"}).alias("messages"), "summary")


def enrichment_upsert(spark, sf):
    return upsert.enrichment_upsert(
        derived.live(spark, sf), derived.label_updates(spark, sf), AS_OF, derived.UPDATE_ORDER
    )


def enrichment_update_only(spark, sf):
    return upsert.enrichment_update_only(
        derived.live(spark, sf), derived.label_updates(spark, sf), derived.UPDATE_ORDER
    )


def _stored(spark, sf):
    """`live` as a table on disk, in small blocks."""
    path = scratch_path(spark, "table")
    append_messages(derived.live(spark, sf), path, block_rows=STORED_BLOCK)
    return path


def _shown_table(spark, sf, path, *more):
    return read_table(spark, path).select(*derived.live(spark, sf).columns, *more)


def stored_label_update(spark, sf):
    path = _stored(spark, sf)
    apply_label_updates(spark, path, derived.label_updates(spark, sf), AS_OF, derived.UPDATE_ORDER)
    return _shown_table(spark, sf, path, "dt_enriched")


def stored_soft_delete(spark, sf):
    path = _stored(spark, sf)
    for _ in range(2):  # the second changes nothing
        apply_soft_delete(spark, path, derived.drop_list(spark, sf))
    return _shown_table(spark, sf, path)


def label_correction(spark, sf):
    """A reviewer's pass, written back and read again."""
    path = _stored(spark, sf)
    correct_labels(spark, path, derived.live(spark, sf), derived.edited(spark, sf), AS_OF)
    return _shown_table(spark, sf, path, "dt_enriched")


def _json_lines(spark, sf):
    """`live` as JSON lines, and a broken line for every tenth message."""
    path = scratch_path(spark, "lines")
    live = derived.live(spark, sf)
    micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    good = live.select(F.to_json(F.struct(*live.columns), micros).alias("value"))
    broken = live.where("id % 10 = 0").select(F.concat(F.lit('{"id": '), "id", F.lit(', "vid_id"')).alias("value"))
    good.unionByName(broken).write.text(path)
    return path


def json_lines_messages(spark, sf):
    return read_messages(spark, _json_lines(spark, sf), "json").select(*derived.live(spark, sf).columns)


def json_lines_rejected(spark, sf):
    return rejected_lines(spark, _json_lines(spark, sf))


def _partly_named(spark, sf):
    return derived.incoming(spark, sf).withColumn("msg_id", F.expr("CASE WHEN length(message) % 7 <> 0 THEN msg_id END"))


def uniqueness_violations(spark, sf):
    batch = derived.incoming(spark, sf).withColumnRenamed("arrival", "id")
    return quality.uniqueness_violations(batch)


def ingest_new_messages(spark, sf):
    return ingest.ingest_new_messages(derived.live(spark, sf), derived.incoming(spark, sf))


def ingest_counts(spark, sf):
    return ingest.ingest_counts(derived.incoming(spark, sf), ingest_new_messages(spark, sf))


def sequence_ids(spark, sf):
    rows = derived.live(spark, sf).select("dt_stamp", "msg_id", "vid_id")
    return ingest.sequence_ids(rows, ["dt_stamp", "msg_id"], name="seq_id")


def stream_ingest_dedup(spark, sf):
    """All messages delivered twice to a stream, none stored before."""
    delivered = derived.live_stream(spark, sf).unionByName(derived.live_stream(spark, sf))
    root = scratch_path(spark, "landed")
    nothing = spark.createDataFrame([], MESSAGES)
    stream_in.stream_ingest(
        delivered, nothing, root, scratch_path(spark, "offsets"), available_now=True
    ).awaitTermination()
    return stream_in.landed_messages(spark, root)


def stream_stance_timeline(spark, sf):
    root = scratch_path(spark, "timeline")
    visible = filters.visible_messages(derived.live_stream(spark, sf))
    stream_time.stream_stance_timeline(
        visible, root, scratch_path(spark, "offsets"), available_now=True
    ).awaitTermination()
    return stream_time.streamed_timeline(spark, root, stream_time.counted(visible).schema)


def stream_enrichment_upsert(spark, sf):
    root = scratch_path(spark, "updates")
    updates = derived.label_update_stream(spark, sf)
    stream_labels.stream_label_updates(
        updates, root, scratch_path(spark, "offsets"), derived.UPDATE_ORDER, available_now=True
    ).awaitTermination()
    log = stream_labels.logged_updates(spark, root, updates.schema)
    return stream_labels.current_messages(derived.live(spark, sf), log, AS_OF)


QUERIES = {
    # registry
    "registry_listing": _on_registry(registry_listing),
    "active_urls": _on_registry(filters.active_urls),
    "registry_status": _on_registry(
        lambda r: filters.registry_status(r, "https://video.example/watch?v=v3")
    ),
    "registry_upsert": lambda s, d: reg.registry_upsert(derived.registry(s, d), _all_urls(s, d)),
    "registry_upsert_counts": lambda s, d: reg.registry_upsert_counts(derived.registry(s, d), _all_urls(s, d)),
    "registry_set_status": lambda s, d: reg.registry_set_status(
        derived.registry(s, d), derived.drop_list(s, d), "start"
    ),
    "registry_stop": lambda s, d: reg.registry_set_status(
        derived.registry(s, d), derived.drop_list(s, d), "stopped"
    ),
    "registry_delete": lambda s, d: reg.registry_delete(derived.registry(s, d), derived.drop_list(s, d)),
    "url_video_key": url_video_key,
    # message views
    "backlog_messages": _on_live(filters.backlog_messages),
    "backlog_limit": _on_live(lambda m: filters.backlog_limit(m, BACKLOG_BATCH)),
    "visible_messages": _on_live(filters.visible_messages),
    "visible_documents": _on_visible(lambda v: v, derived.docmsg),
    "messages_for_videos": lambda s, d: filters.messages_for_videos(
        derived.live(s, d), derived.drop_list(s, d)
    ),
    "select_by_key": select_by_key,
    "domain_violations": _on_visible(filters.domain_violations),
    "domain_violations_documents": _on_visible(filters.domain_violations, derived.docmsg),
    "display_messages": _on_visible(projections.display_messages),
    "editor_messages": _on_visible(projections.editor_messages),
    "edit_payload": edit_payload,
    "legacy_messages": legacy_messages,
    "lenient_timestamps": lenient_timestamps,
    "local_clock": clock,
    # dashboard
    "sentiment_distribution": _on_visible(metrics.sentiment_distribution),
    "flag_rates": _on_visible(metrics.flag_rates),
    "flag_rates_documents": _on_visible(metrics.flag_rates, derived.docmsg),
    "stance_totals": _on_visible(metrics.stance_totals),
    "language_distribution": _on_visible(metrics.language_distribution),
    "language_distribution_documents": _on_visible(metrics.language_distribution, derived.docmsg),
    "corpus_counts": _on_live(metrics.corpus_counts),
    "time_span": _on_visible(metrics.time_span),
    "stance_timeline": _on_visible(timeline.stance_timeline),
    "stance_timeline_adaptive": _on_visible(timeline.stance_timeline_adaptive),
    "stance_timeline_by_video": _on_visible(lambda v: timeline.stance_timeline_adaptive(v, ["vid_id"])),
    "stance_peaks": _on_visible(timeline.stance_peaks),
    "dashboard_overview": _on_live(dashboard_overview),
    # facets and summaries
    "latest_per_facet": _on_visible(facets.latest_per_facet),
    "latest_per_facet_by_video": _on_visible(lambda v: facets.latest_per_facet(v, by=["vid_id"])),
    "latest_per_facet_100": _on_visible(lambda v: facets.latest_per_facet(v, 100)),
    "latest_per_facet_zoned": latest_per_facet_zoned,
    "facet_sufficiency": _on_visible(facets.facet_sufficiency),
    "facet_sufficiency_documents": _on_visible(facets.facet_sufficiency, derived.docmsg),
    "facet_nested": facet_nested,
    "facet_corpus": _on_visible(facets.facet_corpus, derived.docmsg),
    "facet_key_terms": _on_visible(facets.facet_key_terms, derived.docmsg),
    "facet_summaries": facet_summaries,
    "summary_records": summary_records,
    # table maintenance
    "enrichment_upsert": enrichment_upsert,
    "enrichment_update_only": enrichment_update_only,
    "edit_diff": lambda s, d: upsert.edit_diff(derived.live(s, d), derived.edited(s, d)),
    "soft_delete": lambda s, d: reg.soft_delete(derived.live(s, d), derived.drop_list(s, d)),
    "soft_delete_counts": lambda s, d: reg.soft_delete_counts(derived.live(s, d), derived.drop_list(s, d)),
    "delete_counts": lambda s, d: reg.delete_counts(
        derived.registry(s, d), derived.live(s, d), derived.drop_list(s, d)
    ),
    "stored_label_update": stored_label_update,
    "stored_soft_delete": stored_soft_delete,
    "label_correction": label_correction,
    "json_lines_messages": json_lines_messages,
    "json_lines_rejected": json_lines_rejected,
    "ingest_rejects": lambda s, d: ingest.ingest_rejects(_partly_named(s, d)),
    "ingest_new_messages": ingest_new_messages,
    "ingest_counts": ingest_counts,
    "sequence_ids": sequence_ids,
    "uniqueness_violations": uniqueness_violations,
    # streaming
    "stream_ingest_dedup": stream_ingest_dedup,
    "stream_stance_timeline": stream_stance_timeline,
    "stream_enrichment_upsert": stream_enrichment_upsert,
    **STREAM_QUERIES,
}

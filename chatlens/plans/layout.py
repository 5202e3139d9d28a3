"""The message table on disk, and writes that touch only the part that changes.

Messages are stored in blocks of consecutive ids (partition id_block). Ids are handed out in
order of arrival, so new labels mostly concern a few recent blocks. n_chars carries the length
of the text: the length rule then reaches the scan, and panels need not read the text.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.filters import not_deleted, video_keys
from chatlens.operators.registry import soft_delete
from chatlens.operators.upsert import enrichment_upsert, keyed_upsert
from chatlens.schema import MESSAGES, POSITION, REGISTRY, SUPPLIED
from chatlens.session import materialise, passing_copies, remove
from chatlens.sizing import measured_copy

BLOCK_ROWS = 10_000_000
_KEPT = T.StructType([*MESSAGES.fields, *[T.StructField(p, T.LongType()) for p in POSITION]])
STORED = T.StructType([
    *_KEPT.fields, T.StructField("n_chars", T.IntegerType()), T.StructField("block_rows", T.LongType()),
    T.StructField("id_block", T.LongType()),
])


def block_of(column="id", block_rows=BLOCK_ROWS):
    return F.expr(f"{column} div {block_rows}").alias("id_block")


def _laid_out(messages, block_rows):
    missing = {f.name: F.lit(None).cast(f.dataType) for f in _KEPT.fields if f.name not in messages.columns}
    rows = messages.withColumns(missing).select(
        *_KEPT.names, F.length("message").alias("n_chars"), F.lit(block_rows).cast("long").alias("block_rows"),
        block_of("id", block_rows),
    )
    # rebalance: files of even size per block, a large block over several tasks
    return rows.hint("rebalance", "id_block").sortWithinPartitions("id_block", "enriched", "dt_stamp")


def read_table(spark, path):
    return spark.read.schema(STORED).parquet(path)


def table_exists(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def block_size(spark, path, wanted=None):
    """Rows per block of a table, as stored in it. Asking for another size is an error."""
    stored = read_table(spark, path).select("block_rows").first() if table_exists(spark, path) else None
    size = stored["block_rows"] if stored else wanted or BLOCK_ROWS
    if wanted not in (None, size):
        raise ValueError(f"the table has blocks of {size} rows, not {wanted}")
    return size


def append_messages(messages, path, block_rows=None):
    block_rows = block_size(messages.sparkSession, path, block_rows)
    _laid_out(messages, block_rows).write.mode("append").partitionBy("id_block").parquet(path)


def _replace_blocks(messages, path, block_rows):
    """Replace exactly the blocks present in `messages`; read the table anew afterwards."""
    (
        _laid_out(messages, block_rows).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("id_block").parquet(path)
    )


def _blocks(spark, path, blocks):
    """The table, pruned to the blocks listed in a DataFrame: one number per touched directory.

    The list is a join, whose broadcast prunes the directories when the scan starts.
    """
    listed = materialise(blocks.where("id_block >= 0").distinct(), "blocks")
    return read_table(spark, path).join(F.broadcast(listed), "id_block", "left_semi")


def ids_of_blocks(spark, path, rows):
    """id and msg_id of the stored messages in the blocks that the rows' ids fall into; labels without a message
    are left out."""
    blocks = _blocks(spark, path, rows.select(block_of("id", block_size(spark, path))))
    return blocks.select("id", "msg_id").where("msg_id IS NOT NULL")


def insert_messages(spark, path, messages, block_rows=None):
    """Put messages (id and what a collector supplies) into the table, rewriting only the blocks they fall into.

    Done again it changes nothing. A row that labels have reached first gets its message and keeps its labels.
    """
    block_rows = block_size(spark, path, block_rows)
    with passing_copies(spark):
        changes, small = measured_copy(messages.select("id", F.struct(*SUPPLIED).alias("_new")))
        if table_exists(spark, path):
            touched = _blocks(spark, path, changes.select(block_of("id", block_rows))).select(*_KEPT.names)
        else:
            touched = spark.createDataFrame([], _KEPT)
        inserted = keyed_upsert(touched, changes, "id", small=small)
        _replace_blocks(inserted.withColumn("enriched", F.coalesce("enriched", F.lit(False))), path, block_rows)


def apply_label_updates(spark, path, updates, as_of=None, order=("seq",), block_rows=None):
    """Write a batch of labels into the table, rewriting only the blocks it touches."""
    block_rows = block_size(spark, path, block_rows)
    with passing_copies(spark):
        touched = _blocks(spark, path, updates.select(block_of("id", block_rows)))
        changed = enrichment_upsert(touched.select(*_KEPT.names), updates, as_of, order)
        _replace_blocks(changed, path, block_rows)


def apply_soft_delete(spark, path, urls, block_rows=None):
    """Mark the messages of the URLs' videos deleted, rewriting only blocks where that changes a row."""
    block_rows = block_size(spark, path, block_rows)
    with passing_copies(spark):
        open_rows = read_table(spark, path).where(not_deleted()).select("vid_id", "id_block")
        hits = open_rows.join(video_keys(urls), "vid_id", "left_semi")
        touched = _blocks(spark, path, hits.select("id_block"))
        _replace_blocks(soft_delete(touched, urls), path, block_rows)


def rewrite_blocks(spark, path, blocks, change, block_rows=None):
    """Replace the listed blocks (a DataFrame of id_block) by change(rows)."""
    block_rows = block_size(spark, path, block_rows)
    _replace_blocks(change(_blocks(spark, path, blocks)), path, block_rows)


def replace_table(df, path):
    """Overwrite a small table (the registry) with a state computed from itself.

    The new state is written to the shared folder first: overwriting a path that is still
    being read would lose it.
    """
    with passing_copies(df.sparkSession):
        materialise(df, "replace").write.mode("overwrite").parquet(path)


def empty_table(spark, path, schema, confirm):
    """Drop all rows of a table. `confirm` must repeat the path."""
    if confirm != path:
        raise ValueError("to empty a table, repeat its path in `confirm`")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def reset_store(spark, path, registry_path, confirm, root=None):
    """Clear the registry and recreate the message table, and with it the store (keys, ids, landed messages) that
    belongs to it. `confirm` must repeat both paths; nothing is touched otherwise.
    """
    if set(confirm) != {path, registry_path}:
        raise ValueError("to clear messages and registry, repeat both paths in `confirm`")
    empty_table(spark, registry_path, REGISTRY, registry_path)
    for folder in [f"{path.rstrip('/')}_deleted", *([root] if root else [])]:
        remove(spark, folder)
    spark.createDataFrame([], STORED).write.mode("overwrite").partitionBy("id_block").parquet(path)

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; in scripts without spaces each character is a word. Two
fixed masks pick six words each from every place of a text and ignore those between. Test and training hashes are
joined; a hit names a diagonal of the item and the text, along which windows of 13 words are compared word by word. A
window overlaps if at least 11 of 13 words agree. The two masks find every such window: each way to place two
substitutions leaves a seed whole.

Items of fewer than 13 words are one window and need 84 % of their words: those of 7 to 12 words can have one
substitution, for which five more masks leave a seed whole; shorter ones must agree in all words and have one
seed, the whole item. Texts are hashed only with the masks that an item of the benchmark needs.

The seeds of the benchmark and the hits are broadcast only after their size is measured; otherwise they are
joined by shuffle. Words never travel with seeds.

Defined cases: NULL texts and texts without words never overlap; every item with a word counts, so an item of one
word overlaps with all texts that have this word; rows with equal id and text are one document; other columns
are kept by `clean` and ignored otherwise.
"""

from pyspark.sql import functions as F

from chatlens.sizing import broadcast_if_small

MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 7, 8))
WINDOW = 13
SHARE = 0.84  # 11 of 13
# With the first of MASKS: six of seven words, without each of them; the first and the last are left out by places.
SHORT_MASKS = (
    (0, 1, 2, 3, 4, 5), (0, 2, 3, 4, 5, 6), (0, 1, 3, 4, 5, 6), (0, 1, 2, 3, 5, 6), (0, 1, 2, 3, 4, 6))
_ALL = MASKS + SHORT_MASKS + tuple(tuple(range(n)) for n in range(1, 6))
_SHORT = 7  # words of the shortest item that can have a substitution
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def words_of(text):
    apart = F.regexp_replace(F.lower(text), f"({_UNSPACED})", " $1 ")
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def masks_for(size):
    """The masks that find every overlap with an item of so many words."""
    if size >= WINDOW:
        return MASKS
    return (MASKS[0], *SHORT_MASKS) if size >= _SHORT else (tuple(range(size)),)


def _seed(mask):
    """Hash of the masked words at a place; NULL where the mask doesn't fit."""
    words = [F.get("words", F.col("at") + o) for o in mask]
    fits = F.col("at") + mask[-1] < F.size("words")
    return F.when(fits, F.xxhash64(F.lit(_ALL.index(mask)), *words))


def _placed(texts, span, *columns):
    """One row for each place where `span` words follow."""
    return texts.filter(F.size("words") >= span).select(
        *columns, "words", F.explode(F.sequence(F.lit(0), F.size("words") - span)).alias("at"))


def _seeded_items(items):
    """One row for each place and mask of an item: item_key, item_at, mask and seed."""
    placed = _placed(items, 1, "item_key")
    needed = F.when(F.size("words") >= WINDOW, _seeds(MASKS))
    for size in range(1, WINDOW):
        needed = needed.when(F.size("words") == size, _seeds(masks_for(size)))
    return placed.select("item_key", F.col("at").alias("item_at"), F.explode(needed).alias("s")).select(
        "item_key", "item_at", "s.mask", "s.seed").filter("seed IS NOT NULL")


def _seeds(masks):
    return F.array(*[F.struct(F.lit(_ALL.index(m)).alias("mask"), _seed(m).alias("seed")) for m in masks])


def _seeded_texts(texts, masks):
    """One row for each place and mask: key, doc_id, at (place) and seed; not the words, which would be copied to each."""
    placed = _placed(texts, min(m[-1] for m in masks) + 1, "key", "doc_id")
    return placed.select("key", "doc_id", "at", F.explode(F.array(*[_seed(m) for m in masks])).alias("seed"))


def _agreed():
    """Most agreeing words in a window on one of the diagonals, and the width of windows."""
    size = F.size("item_words")
    width = F.least(F.lit(WINDOW), size)

    def agreed(diagonal):
        def in_window(start):
            return F.aggregate(
                F.sequence(start, start + width - 1), F.lit(0),
                lambda n, i: n + F.when(F.get("item_words", i) == F.get("words", diagonal + i), 1).otherwise(0))
        return F.array_max(F.transform(F.sequence(F.lit(0), size - width), in_window))

    return F.array_max(F.transform("diagonals", agreed)), width


def overlaps(documents, benchmark):
    """(key, doc_id, item_id, agreed, first_word, n_hits): documents and the items they overlap with."""
    items = benchmark.select(
        "item_id", F.xxhash64("item_id", "text").alias("item_key"), words_of("text").alias("words")).distinct()
    texts = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", words_of("text").alias("words"))
    wanted = broadcast_if_small(_seeded_items(items))
    used = sorted(r["mask"] for r in wanted.select("mask").distinct().collect())  # of 12 at most
    masks = [_ALL[i] for i in used] or MASKS
    hits = _seeded_texts(texts, masks).join(wanted, "seed").groupBy("key", "doc_id", "item_key").agg(
        F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"), F.min("at").alias("first_word"),
        F.count("*").alias("n_hits"))
    hits = broadcast_if_small(hits.select(
        F.col("key").alias("hit_key"), F.col("doc_id").alias("hit_id"), "item_key", "diagonals", "first_word", "n_hits"))
    both = texts.join(hits, (texts["key"] == hits["hit_key"]) & texts["doc_id"].eqNullSafe(hits["hit_id"]))
    both = both.join(broadcast_if_small(items.withColumnRenamed("words", "item_words")), "item_key")
    agreed, width = _agreed()
    judged = both.select("key", "doc_id", "item_id", "first_word", "n_hits", agreed.alias("agreed"), width.alias("width"))
    return judged.filter(F.col("agreed") >= F.ceil(F.col("width") * SHARE)).groupBy("key", "doc_id", "item_id").agg(
        F.max("agreed").alias("agreed"), F.min("first_word").alias("first_word"), F.max("n_hits").alias("n_hits"))


def clean(documents, benchmark):
    """The documents that overlap with no item, all columns unchanged."""
    named = overlaps(documents, benchmark).select(F.struct("key", "doc_id").alias("leak")).distinct()
    leaks = broadcast_if_small(named.select("leak.*"))
    same = (F.xxhash64(documents["doc_id"], documents["text"]) == leaks["key"]) & documents["doc_id"].eqNullSafe(
        leaks["doc_id"])
    return documents.join(leaks, same, "left_anti")

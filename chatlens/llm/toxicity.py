"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text: the distinct words (letters and digits, ASCII lower-cased), word pairs, and pairs
that skip one word, hashed to 2**20 places. FTRL-proximal keeps a rate for each place and its L1 term
leaves most weights at zero, so the model is a short list of (place, weight) sent to every task.

Training reads at most MAX_ROWS labelled texts, the first ones in an order by hashed id; scoring reads
every text once, without a shuffle.

Defined cases: NULL and empty texts have no features and score the base rate; rows whose id or label is
NULL are never learnt from; without labelled rows every score is 0.5; repeated rows are scored each;
other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatlens.llm import flat

MAX_ROWS = 20_000
BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.0
EPOCHS = 3
THRESHOLD = 0.3
_PLACES = np.uint64((1 << BITS) - 1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(data, offsets):
    """Hashed features with repeats: places, and the text of each; not in the order of the texts."""
    starts, ends, bounds = flat.words(flat.LOWER[data], offsets, flat.LETTERS)
    word = flat.word_hashes(flat.LOWER[data], starts, ends)
    owner = flat.owners(bounds)
    places, texts = [word & _PLACES], [owner]
    for skip in (1, 2):
        same = owner[:-skip] == owner[skip:]
        pair = flat.mix(word[:-skip] * _PAIR + word[skip:] + np.uint64(skip))
        places.append((pair & _PLACES)[same])
        texts.append(owner[:-skip][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(texts)


def _distinct(places, texts, n):
    """Sorted distinct places of each text, and their bounds."""
    key = np.unique(texts << BITS | places)
    return key & int(_PLACES), np.searchsorted(key, np.arange(n + 1) << BITS)


def _featurise(batches):
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text")):
            places, bounds = _distinct(*features(data, offsets), n)
            rows = [places[bounds[i]:bounds[i + 1]].astype(np.uint32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn").slice(first, n), batch.column("label").slice(first, n), pa.array(rows, pa.binary())],
                ["turn", "label", "places"],
            )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(rows, labels):
    """FTRL-proximal over the rows in turn; the intercept has its own rate and no L1."""
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, bias_n = np.log(rate / (1 - rate)), 0.0
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weight(z, n):
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for places, label in zip(rows, labels):
            zi, ni = z[places], n[places]
            w = weight(zi, ni)
            slope = _sigmoid(bias + w.sum()) - label
            z[places] = zi + slope - (np.sqrt(ni + slope * slope) - np.sqrt(ni)) / ALPHA * w
            n[places] = ni + slope * slope
            bias_n += slope * slope
            bias -= 0.05 * slope / (1 + np.sqrt(bias_n))
    w = weight(z, n)
    used = np.flatnonzero(w)
    return bias, used, w[used]


def _train(batches):
    rows, labels = [], []
    for batch in batches:
        rows += [np.frombuffer(x, np.uint32) for x in batch.column("places").to_pylist()]
        labels += batch.column("label").to_pylist()
    if rows:
        bias, used, weights = _fit(rows, np.array(labels, float))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], used]), pa.int64()), pa.array(np.concatenate([[bias], weights]))],
            ["place", "weight"],
        )


def held_out(doc_id):
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(documents, labels, label="toxic", max_rows=MAX_ROWS):
    """Fit on labelled rows that aren't held out: a list of (place, weight), the intercept at place -1."""
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = (
        documents.select(F.col("doc_id").alias("id"), "text")
        .join(F.broadcast(chosen), "id")  # at most max_rows ids
        .select(F.xxhash64("id").alias("turn"), "label", "text")
    )
    rows = texts.mapInArrow(_featurise, "turn long, label double, places binary")
    ordered = rows.repartition(1).sortWithinPartitions("turn", "places").limit(max_rows)
    model = ordered.mapInArrow(_train, "place long, weight double")
    return [tuple(r) for r in model.collect()]


def score(documents, model):
    """doc_id, held_out, score and predicted of every document."""
    bias = dict(model).get(-1, 0.0)
    sparse = [(p, w) for p, w in model if p >= 0]
    used = np.array([p for p, _ in sparse], np.int64)
    values = np.array([w for _, w in sparse], np.float32)

    def scored(batches):
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = values
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text")):
                places, texts = features(data, offsets)
                hit = weights[places] != 0
                places, bounds = _distinct(places[hit], texts[hit], n)
                sums = flat.sums_by_text(weights[places].astype(float), bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(_sigmoid(bias + sums))], ["doc_id", "score"]
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    scores = documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double")
    return scores.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

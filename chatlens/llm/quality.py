"""Quality: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(score - threshold_k): one weight vector shared by all grades, and ordered
thresholds. The score of a text is the mean weight of its hashed words plus the mean weight of its
character shapes (runs of three characters after letters, digits and spaces are reduced to their class),
so that it doesn't depend on the length. It gives the expected grade and the probability of each tail,
by which documents are kept.

Training reads at most MAX_ROWS rated texts, the first ones in an order by hashed id.

Defined cases: NULL and empty texts score 0, so that the thresholds alone decide; rows whose id or rating
is NULL are never learnt from; without rated rows every document is kept, with NULL grade and tails; repeated
rows are judged each; other columns are kept by `keep` and ignored otherwise; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.llm.workers import thrifty

MAX_ROWS = 20_000
TOP = 2  # the best grade of `grade_of`
BITS = 18
EPOCHS = 6
RATE = 0.5
SCALE = 20.0
LEAST_TAIL = 0.5
SLICE_BYTES = 1 << 19
_PLACES = np.uint64((1 << BITS) - 1)
_SHAPES = np.arange(256, dtype=np.uint8)
_SHAPES[0x61:0x7B] = ord("a")
_SHAPES[0x80:] = ord("a")
_SHAPES[0x41:0x5B] = ord("A")
_SHAPES[0x30:0x3A] = ord("0")
_SHAPES[~flat.NOT_SPACE] = ord(" ")


def _families(data, offsets):
    """Two families of (places in text order, bounds of each text)."""
    lower = flat.LOWER[data]
    starts, ends, bounds = flat.words(lower, offsets, flat.LETTERS)
    yield (flat.word_hashes(lower, starts, ends) & _PLACES >> np.uint64(1)).astype(np.int64), bounds
    shape = _SHAPES[data].astype(np.uint64)
    triple = flat.mix(shape[:-2] << np.uint64(16) | shape[1:-1] << np.uint64(8) | shape[2:])
    inside = np.ones(max(len(data) - 2, 0), bool)
    for back in (1, 2):  # not across the end of a text
        cut = offsets[1:-1] - back
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    at = np.flatnonzero(inside)
    yield (triple[at] & _PLACES >> np.uint64(1)).astype(np.int64) | 1 << BITS - 1, np.searchsorted(at, offsets)


def _scores(weights, data, offsets):
    total = np.zeros(len(offsets) - 1)
    for places, bounds in _families(data, offsets):
        total += flat.sums_by_text(weights[places], bounds) * SCALE / np.maximum(np.diff(bounds), 1)
    return total


@thrifty
def _featurise(batches):
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text"), SLICE_BYTES):
            rows = [[] for _ in range(n)]
            for places, bounds in _families(data, offsets):
                for i in range(n):
                    place, count = np.unique(places[bounds[i]:bounds[i + 1]], return_counts=True)
                    rows[i].append((place.astype(np.uint32), (count * SCALE / max(count.sum(), 1)).astype(np.float32)))
            place = [np.concatenate([p for p, _ in r]).tobytes() for r in rows]
            value = [np.concatenate([v for _, v in r]).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(first, n) for c in ("turn", "grade")]
                + [pa.array(place, pa.binary()), pa.array(value, pa.binary())],
                ["turn", "grade", "places", "parts"],
            )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(rows, grades, top):
    """Adagrad over the rows in turn; thresholds are a first one and positive gaps."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4)
    share = [np.clip((grades >= k).mean(), 0.02, 0.98) for k in range(1, top + 1)]
    cuts = np.maximum.accumulate(-np.log(np.array(share) / (1 - np.array(share))) + 1e-3 * np.arange(top))
    cut_seen = np.full(top, 1.0)
    for _ in range(EPOCHS):
        for (places, parts), grade in zip(rows, grades):
            parts = parts.astype(float)  # all rows are held in half of that
            above = _sigmoid((weights[places] * parts).sum() - cuts)
            tails = np.concatenate([[1.0], above, [0.0]])
            spread = np.concatenate([[0.0], above * (1 - above), [0.0]])
            here = max(tails[grade] - tails[grade + 1], 1e-6)
            slope = (spread[grade] - spread[grade + 1]) / here
            step = slope * parts
            seen[places] += step * step
            weights[places] += RATE * 0.1 * step / np.sqrt(seen[places])
            push = np.zeros(top)
            if grade > 0:
                push[grade - 1] -= spread[grade] / here
            if grade < top:
                push[grade] += spread[grade + 1] / here
            cut_seen += push * push
            cuts = np.maximum.accumulate(cuts + RATE * push / np.sqrt(cut_seen))
    return weights, cuts


def _trainer(top):
    @thrifty
    def train_all(batches):
        rows, grades = [], []
        for batch in batches:
            rows += [
                (np.frombuffer(p, np.uint32), np.frombuffer(v, np.float32))
                for p, v in zip(batch.column("places").to_pylist(), batch.column("parts").to_pylist())
            ]
            grades += batch.column("grade").to_pylist()
        if rows:
            weights, cuts = _fit(rows, np.array(grades, int), top)
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([-1 - np.arange(top), used]), pa.int64()),
                 pa.array(np.concatenate([cuts, weights[used]]))],
                ["place", "weight"],
            )
    return train_all


def grade_of(labels):
    """Ratings 0, 1, 2 from two labels: poor, sound but toxic, sound and clean."""
    sound = F.coalesce(F.col("quality"), F.lit(0)) > 0
    grade = F.when(~sound, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("quality IS NOT NULL").select("doc_id", grade.alias("grade"))


def train(documents, ratings, top=2, max_rows=MAX_ROWS):
    """Fit grades 0 to `top`; a dictionary with the used places, their weights, and the thresholds."""
    chosen = (
        ratings.select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("grade"))
        .filter(F.col("id").isNotNull() & F.col("grade").between(0, top))
        .groupBy("id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = (
        documents.select(F.col("doc_id").alias("id"), "text")
        .join(F.broadcast(chosen), "id")  # at most max_rows ids
        .select(F.xxhash64("id").alias("turn"), "grade", "text")
    )
    rows = texts.mapInArrow(_featurise, "turn long, grade int, places binary, parts binary")
    ordered = rows.repartition(1).sortWithinPartitions("turn", "places").limit(max_rows)
    got = [tuple(r) for r in ordered.mapInArrow(_trainer(top), "place long, weight double").collect()]
    cuts = [w for p, w in sorted(got, reverse=True) if p < 0]
    used = [(p, w) for p, w in got if p >= 0]
    return {
        "cuts": cuts, "places": np.array([p for p, _ in used], np.int64),
        "weights": np.array([w for _, w in used], np.float32),
    }


def _dense(model):
    weights = np.zeros(1 << BITS, np.float32)
    weights[model["places"]] = model["weights"]
    return weights


def assess(documents, model, top=TOP):
    """doc_id, expected_grade, tail_1 .. tail_top (probability of that grade or a better one) and keep.

    The columns follow from `top`, the best grade there is, not from the ratings: without ratings nothing is known of a
    document, so all but keep (true) is NULL; a grade above the best one rated has tail 0.
    """
    if len(model["cuts"]) > top:
        raise ValueError(f"the ratings go beyond grade {top}")
    tail_names = [f"tail_{k + 1}" for k in range(top)]
    if not model["cuts"]:
        nothing = [F.lit(None).cast("double").alias(c) for c in ["expected_grade", *tail_names]]
        return documents.select("doc_id", *nothing, F.lit(True).alias("keep"))

    @thrifty
    def assessed(batches):
        weights = _dense(model)
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), SLICE_BYTES):
                score = _scores(weights, data, offsets)
                tails = [_sigmoid(score - cut) for cut in model["cuts"]]
                tails += [np.zeros(n)] * (top - len(tails))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.sum(tails, axis=0)), *map(pa.array, tails),
                     pa.array(tails[0] >= LEAST_TAIL)],
                    ["doc_id", "expected_grade", *tail_names, "keep"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    columns = "".join(f", {c} double" for c in tail_names)
    return documents.select("doc_id", "text").mapInArrow(
        assessed, f"doc_id {id_type}, expected_grade double{columns}, keep boolean"
    )


def keep(documents, model):
    """The documents whose probability of grade 1 or better is at least LEAST_TAIL, all columns unchanged."""
    if not model["cuts"]:
        return documents
    at = documents.columns.index("text")

    @thrifty
    def kept(batches):
        weights = _dense(model)
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column(at), SLICE_BYTES):
                tail = _sigmoid(_scores(weights, data, offsets) - model["cuts"][0])
                yield pc.filter(batch.slice(first, n), pa.array(tail >= LEAST_TAIL))

    return documents.mapInArrow(kept, documents.schema)

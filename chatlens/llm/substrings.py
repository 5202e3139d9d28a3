"""Substring dedup on words: remove every word in a window that occurs more than once.

Windows of 35 words are found by super-k-mers (see superkmers): consecutive windows with the same
minimiser travel as one packed string to the bucket of that minimiser, where sorting counts them exactly.

Defined cases: NULL or empty texts have no words and keep the hash of the empty string; texts shorter
than a window are kept whole; equal rows count as occurrences of each other; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chatlens.llm import flat
from chatlens.llm.superkmers import Windows, covered, prepared, repeated_windows, with_runs

WINDOW = 35
MINIMISER = 8


def _parse(data, offsets):
    starts, ends, bounds = flat.words(data, offsets)
    return flat.word_hashes(data, starts, ends), bounds, starts, ends


def _joined(data, starts, ends):
    """The words with one space after each, and the place of every word in that."""
    sizes = ends - starts + 1
    at = flat.ranges(starts, sizes)
    packed = data[np.minimum(at, max(len(data) - 1, 0))]
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    packed[places[1:] - 1] = 0x20
    return packed, places


def _pack(parsed, data, low, high):
    """Words low to high of each super-k-mer as one string."""
    _, _, starts, ends = parsed
    word = flat.ranges(low, high - low)
    packed, places = _joined(data, starts[word], ends[word])
    cuts = places[np.concatenate([[0], np.cumsum(high - low)])]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(low), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).cast(pa.binary())


def _sorted_windows(k):
    def solve(strings, c, least):
        """String, place, total count and smallest id of every window, by sorting ranks of growing runs of words."""
        data, offsets = flat.byte_array(strings)
        starts, ends, bounds = flat.words(data[:offsets[-1]], offsets)
        cuts = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=cuts[1:])
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts),
            [None, pa.py_buffer(cuts), pa.py_buffer(data[flat.ranges(starts, ends - starts)])])
        rank = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)
        have = 1
        while have < k:
            step = min(have, k - have)
            pair = rank[:-step] * (len(starts) + 1) + rank[step:]
            rank = np.unique(pair, return_inverse=True)[1]
            have += step
        room = np.diff(bounds) - k + 1
        row = np.repeat(np.arange(len(room)), room)
        window = flat.ranges(bounds[:-1], room)
        kind = rank[window]
        total = np.bincount(kind, c[row]).astype(np.int64)[kind]
        smallest = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, kind, least[row])
        return row, window - bounds[:-1][row], total, smallest[kind]
    return solve


def word_windows(k=WINDOW, m=MINIMISER):
    return Windows(k, m, m, _parse, _pack, _sorted_windows(k), once_a_document=False)


def _cut(k, with_text):
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text")):
                starts, ends, bounds = flat.words(data, offsets)
                gone = covered(batch, first, n, bounds, k)
                packed, places = _joined(data, starts[~gone], ends[~gone])
                kept = np.concatenate([[0], np.cumsum(~gone)])[bounds]
                cuts = places[kept]
                raw = packed.tobytes()
                texts = [raw[a:max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:])]
                words = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(words), pa.array(words - np.diff(kept)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                     *([pa.array(texts, pa.binary()).cast(pa.string())] if with_text else [])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])],
                )
    return run


def dedup(documents, k=WINDOW, with_text=True):
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every document."""
    texts = prepared(documents)
    marks = repeated_windows(texts, word_windows(k)).filter("copies = 1").drop("least")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return with_runs(texts, "copies > 1", marks).mapInArrow(
        _cut(k, with_text), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string"
        + ", kept string" * with_text)

"""Suffix-array dedup on bytes: remove every byte in a 50-byte string that an earlier document also has.

Shards are the buckets of 50-byte windows by minimiser (see superkmers), so that equal strings meet in one
shard. A shard's strings are joined and their suffixes sorted by induced sorting: suffixes are classified,
the leftmost-smaller (LMS) substrings are sorted and named, the string of names is sorted by recursion, and
the rest is induced in two passes over the buckets. The permuted common prefixes of neighbours, cut at 50,
then give the classes of equal windows.

The passes work on whole buckets at once, which suits small alphabets. A string of names with more than
MOST_SYMBOLS different ones is sorted by doubling ranks instead, up to the order that 50 bytes need.

Defined cases: NULL and empty texts have 0 bytes and keep the hash of the empty string; a NULL id counts
as larger than any other; rows with equal ids don't remove bytes of each other; other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.llm.superkmers import Windows, covered, prepared, repeated_windows, with_runs

WINDOW = 50
MINIMISER = 30
CHOICE = 9
MOST_SYMBOLS = 512


def _smaller(text):
    """Whether each suffix is smaller than the next one; the last symbol is the least and unique."""
    size = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    following = change[np.minimum(np.searchsorted(change, np.arange(size - 1)), len(change) - 1)]
    out = np.ones(size, bool)
    out[:-1] = text[following] < text[following + 1]
    return out


class _Buckets:
    """The places of a suffix array by first symbol, filled in groups."""

    def __init__(self, text):
        self.text = text
        self.size = np.bincount(text)
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        self.array = np.full(len(text), -1, np.int64)

    def _grouped(self, suffixes):
        symbols = self.text[suffixes]
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
        counts = np.diff(first, append=len(symbols))
        return suffixes[order], symbols[first], counts, np.arange(len(symbols)) - np.repeat(first, counts)

    def put_first(self, suffixes, heads):
        """Put suffixes, smallest first, behind what their buckets hold from the left."""
        if len(suffixes):
            suffixes, symbols, counts, rank = self._grouped(suffixes)
            self.array[np.repeat(heads[symbols], counts) + rank] = suffixes
            heads[symbols] += counts

    def put_last(self, suffixes, tails):
        """Put suffixes, largest first, before what their buckets hold from the right."""
        if len(suffixes):
            suffixes, symbols, counts, rank = self._grouped(suffixes)
            self.array[np.repeat(tails[symbols], counts) - 1 - rank] = suffixes
            tails[symbols] -= counts


def _induce(text, smaller, lms):
    """Suffix array from the LMS suffixes in order (or, for the first use, in any order of their substrings)."""
    buckets = _Buckets(text)
    array, heads, tails = buckets.array, buckets.starts.copy(), buckets.ends.copy()
    buckets.put_last(lms[::-1], tails)
    symbols = np.flatnonzero(buckets.size)
    for c in symbols:
        done = buckets.starts[c]
        while done < heads[c]:
            before = array[done:heads[c]] - 1
            done = heads[c]
            before = before[before >= 0]
            buckets.put_first(before[~smaller[before]], heads)
        before = array[tails[c]:buckets.ends[c]] - 1
        buckets.put_first(before[before >= 0], heads)
    tails = buckets.ends.copy()
    buckets.put_last(np.array([len(text) - 1]), tails)
    for c in symbols[::-1]:
        done = buckets.ends[c]
        while done > tails[c]:
            before = array[tails[c]:done][::-1] - 1
            done = tails[c]
            before = before[before >= 0]
            buckets.put_last(before[smaller[before]], tails)
        before = array[buckets.starts[c]:heads[c]][::-1] - 1
        before = before[before >= 0]
        buckets.put_last(before[smaller[before]], tails)
    return array


def _by_doubling(names, depth):
    """Order of the suffixes of a string of names by their first `depth` names at least."""
    rank, have = np.append(names, -1) + 1, 1
    size = len(names)
    while have < depth and len(np.unique(rank[:size])) < size:
        later = np.zeros(size, np.int64)
        later[:max(size - have, 0)] = rank[have:size]
        rank = np.append(np.unique(rank[:size] * (size + 2) + later, return_inverse=True)[1] + 1, 0)
        have *= 2
    return np.argsort(rank[:size], kind="stable")


def suffix_array(text, depth=WINDOW):
    """Suffixes in the order of their first `depth` symbols at least; text ends with its only 0."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = _induce(text, smaller, lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    following = np.append(lms[1:], len(text) - 1) + 1  # a substring ends with the next LMS symbol
    ends = np.zeros(len(text), np.int64)
    ends[lms] = following
    roller = flat.rolling(8)
    spans = roller.spans(roller.prefix(flat.mix(text.astype(np.uint64) + np.uint64(1))), ordered, ends[ordered])
    name = np.zeros(len(text), np.int64)
    name[ordered] = np.cumsum(np.concatenate([[0], spans[1:] != spans[:-1]]))
    names = name[lms]
    different = int(names.max()) + 1
    if different == len(lms):
        order = np.argsort(names)
    elif different <= MOST_SYMBOLS:
        order = suffix_array(names, depth)  # the last name is the text's end, the only 0
    else:
        order = _by_doubling(names, depth)
    return _induce(text, smaller, lms[order])


def common_prefixes(text, order, cap=WINDOW):
    """By suffix: symbols shared with the suffix before it in the order, at most `cap` (permuted)."""
    size = len(text)
    before = np.full(size, size, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(size + cap + 16, np.uint16)
    padded[:size] = text
    four = np.ndarray(shape=(size + cap + 12,), dtype="<u8", buffer=padded, strides=(2,))
    shared = np.zeros(size, np.int64)
    active = np.arange(size)
    for done in range(0, cap, 4):
        differ = four[active + done] ^ four[before[active] + done]
        low = differ & (~differ + np.uint64(1))  # the lowest set bit tells how many symbols agree
        agree = np.where(differ == 0, 4, np.searchsorted(_STEPS, low, "right") - 1)
        shared[active] += agree
        active = active[agree == 4]
    return np.minimum(shared, cap)


_STEPS = np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)


def _parse(data, offsets):
    return data, offsets


def _pack(parsed, data, low, high):
    cuts = np.concatenate([[0], np.cumsum(high - low)])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(low), [None, pa.py_buffer(cuts), pa.py_buffer(data[flat.ranges(low, high - low)])]
    ).cast(pa.binary())


def _sorted_suffixes(k):
    def solve(strings, c, least):
        """String, place, total count and smallest id of every window, from the shard's suffix array."""
        data, offsets = flat.byte_array(strings)
        sizes = np.diff(offsets)
        text = np.ones(int(sizes.sum()) + len(sizes) + 1, np.uint16)  # 1 between strings, 0 at the end
        at = offsets[:-1] - offsets[0] + np.arange(len(sizes))
        text[flat.ranges(at, sizes)] = data[offsets[0]:offsets[-1]].astype(np.uint16) + 2
        text[-1] = 0
        order = suffix_array(text, k)
        kind = np.zeros(len(text), np.int64)
        kind[order] = np.cumsum(common_prefixes(text, order, k)[order] < k)
        room = sizes - k + 1
        row = np.repeat(np.arange(len(sizes)), room)
        place = flat.ranges(np.zeros(len(sizes), np.int64), room)
        kind = kind[at[row] + place]
        total = np.bincount(kind, c[row]).astype(np.int64)[kind]
        smallest = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, kind, least[row])
        return row, place, total, smallest[kind]
    return solve


def byte_windows(k=WINDOW):
    m = k * MINIMISER // WINDOW
    return Windows(k, m, min(CHOICE, m), _parse, _pack, _sorted_suffixes(k), once_a_document=True)


def _cut(k, with_bytes):
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text")):
                gone = covered(batch, first, n, offsets, k)
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                edge[heads] = gone[heads]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
                spans = np.diff(np.concatenate([[0], np.cumsum(edge)])[offsets])
                kept = data[~gone].tobytes()
                cuts = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
                parts = [kept[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.diff(offsets)), pa.array(removed),
                     pa.array(spans), pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                     *([pa.array(parts, pa.binary())] if with_bytes else [])],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])],
                )
    return run


def dedup(documents, k=WINDOW, with_bytes=True):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every document."""
    texts = prepared(documents)
    earlier = "{0} IS NOT NULL AND ({1} IS NULL OR {0} < {1})"
    marks = repeated_windows(texts, byte_windows(k)).filter(earlier.format("least", "doc_id")).drop("least")
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return with_runs(texts, earlier.format("first", "long_id"), marks).mapInArrow(
        _cut(k, with_bytes), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + ", kept binary" * with_bytes)

"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of words with smallest period q (words q apart are identical), at least LEAST words and two
periods long, that no neighbouring word extends keeping the period. All runs of all texts are found:

- Periods below six are read off directly: where words q apart agree.
- For each scale t = 2, 4, 8, ... a synchronising set holds the positions whose window of t words has, within the
  next t + 1 windows, the smallest hash at the first or the last place. Windows inside highly periodic regions (a
  period of at most t / 3) don't count. Whether a position belongs depends on the 2 t words from there alone, its
  context, and every t positions hold one unless the text around is highly periodic. Two positions of the set with
  equal contexts, 3 t to 6 t apart, propose their distance as a period; so each scale proposes the periods of
  its own range, from a number of pairs that is linear in the text.
- A period whose repeated part lies in a highly periodic region has no position in the set. Such a region, a run of
  a smaller scale, ends where the period starts again; two runs of equal small period that meet there propose all
  distances at which they agree.
- A proposal is extended to both sides by hashes of doubling spans. Every run is compared word by word at the end;
  should a hash ever have deceived, the slice is done again with other hashes.

No shuffle: each text is one row, and slices of about two megabytes of text are done at a time.

Defined cases: NULL and empty texts have no words and no runs, their columns of the greatest run are NULL, and both
hashes are those of the empty string. Texts of any length are searched whole, also a single one longer than a slice.
Rows with NULL or repeated ids count each; other columns are ignored; an empty table gives no rows. Of runs of equal
length the one that starts first is the greatest, then the one of smaller period.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chatlens.llm import flat

LEAST = 12
SMALL = 6  # periods below are read off directly; the first scale starts here
_NONE = np.uint64((1 << 64) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Text:
    """Hashes of all spans of 1, 2, 4, ... symbols, each mixed from its two halves; spans that pass the end differ
    from all others."""

    def __init__(self, symbols, longest, seed):
        self.size = len(symbols)
        last = flat.mix(np.arange(self.size, dtype=np.uint64) + np.uint64((seed + 1) << 40))
        self.levels = [flat.mix(symbols.astype(np.uint64) + np.uint64((seed + 1) << 20))]
        while 1 << len(self.levels) <= longest:
            half, below = 1 << len(self.levels) - 1, self.levels[-1]
            level = last.copy()
            level[:self.size - half] = flat.mix(below[:self.size - half] * _SPREAD + below[half:])
            self.levels.append(level)

    def windows(self, width):
        """By first symbol; width is a power of two."""
        return self.levels[width.bit_length() - 1]

    def common(self, left, right, forward):
        """Symbols that agree from left and right (left < right) onwards, or before them going backwards."""
        done = np.zeros(len(left), np.int64)
        for k in reversed(range(len(self.levels))):
            step = 1 << k
            low = left + done if forward else left - done - step
            high = right + done if forward else right - done - step
            fits = np.flatnonzero((high + step <= self.size) & (low >= 0))
            same = self.levels[k][low[fits]] == self.levels[k][high[fits]]
            done[fits[same]] += step
        return done


def _primitive(runs):
    """Runs (start, length, period) by place; of several periods for one stretch the smallest."""
    start, length, period = runs
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def _joined(*parts):
    return tuple(np.concatenate(x) for x in zip(*parts))


def _direct(symbols, period):
    """Stretches with a small period, read off where symbols that far apart agree."""
    if len(symbols) <= period:
        return (np.zeros(0, np.int64),) * 3
    same = np.zeros(len(symbols) - period + 2, bool)
    same[1:-1] = symbols[period:] == symbols[:-period]
    start = np.flatnonzero(same[1:] & ~same[:-1])
    end = np.flatnonzero(same[:-1] & ~same[1:])
    long = end - start >= period
    start, end = start[long], end[long]
    return start, end - start + period, np.full(len(start), period)


def synchronising_set(text, at, scale, regions):
    """Those of the positions `at` (whole texts) in the set of a scale; regions: starts and lengths of runs with a
    period of at most a third of it."""
    hashes = np.minimum(text.windows(scale)[at], _NONE - np.uint64(1))
    start, length = regions
    inside = length >= scale
    if inside.any():
        edges = np.zeros(text.size + 1, np.int64)
        np.add.at(edges, start[inside], 1)
        np.add.at(edges, start[inside] + length[inside] - scale + 1, -1)
        hashes[np.cumsum(edges)[at] > 0] = _NONE
    least = flat.window_minima(hashes, scale + 1)
    chosen = (least != _NONE) & ((least == hashes[:-scale]) | (least == hashes[scale:]))
    return at[:-scale][chosen]


def _pairs(text, places, scale):
    """(position, distance) of places with equal contexts, 3 to 6 scales apart."""
    context = text.windows(2 * scale)[places]
    order = np.argsort(context, kind="stable")
    place, context = places[order], context[order]
    again = np.flatnonzero(context[1:] == context[:-1])
    found, ahead = [], 1
    while len(again):
        distance = place[again + ahead] - place[again]
        again, distance = again[distance < 6 * scale], distance[distance < 6 * scale]
        far = distance >= 3 * scale
        found.append((place[again[far]], distance[far]))
        ahead += 1
        again = again[again + ahead < len(place)]
        again = again[context[again + ahead] == context[again]]
    return _joined((np.zeros(0, np.int64),) * 2, *found)


def _meeting(text, runs, scale):
    """(position, distance) for pairs of long runs of one small period, the second starting where the first ends."""
    start, length, period = (x[(runs[1] >= 3 * scale) & (3 * runs[2] <= scale)] for x in runs)
    order = np.lexsort((start, period))
    start, end, period = start[order], (start + length)[order], period[order]
    found = []
    for k in np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1])):
        q, second = int(period[k]), start[k + 1]
        width = 1 << q.bit_length() - 1  # two spans of this width cover a period
        words, place = text.windows(width), np.arange(end[k] - 2 * q + 1, end[k] - q + 1)
        equal = np.flatnonzero((words[place] == words[second]) & (words[place + q - width] == words[second + q - width]))
        if len(equal):
            distance = np.arange(3 * scale + (second - place[equal[-1]] - 3 * scale) % q, 6 * scale, q)
            place = np.maximum(start[k], second - distance)
            inside = place + distance < end[k + 1]
            found.append((place[inside], distance[inside]))
    return _joined((np.zeros(0, np.int64),) * 2, *found)


def _extended(text, place, period, scale):
    """Runs from proposals; proposals of one period whose contexts touch belong to one run."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    head = np.ones(len(place), bool)
    head[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 2 * scale)
    place, period = place[head], period[head]
    after = text.common(place, place + period, True)
    before = text.common(place, place + period, False)
    long = after + before >= period
    return (place - before)[long], (after + before + period)[long], period[long]


def find_runs(symbols, bounds, seed=0):
    """(start, length, period) of all stretches of at least two periods, smallest period, maximal, none across bounds.

    Texts are separated by symbols that occur once, so nothing repeats across them.
    """
    sizes = np.diff(bounds)
    spaced = np.zeros(len(symbols) + len(sizes), np.int64)
    spaced[np.arange(len(symbols)) + flat.owners(bounds)] = symbols
    spaced[bounds[1:] + np.arange(len(sizes))] = -1 - np.arange(len(sizes))
    first = bounds[:-1] + np.arange(len(sizes))
    runs = _primitive(_joined(*[_direct(spaced, q) for q in range(1, SMALL)]))
    scale, longest = SMALL // 3, int(sizes.max(initial=0))
    text = _Text(spaced, longest, seed)
    while 6 * scale <= longest:
        long = np.flatnonzero(sizes >= 6 * scale)  # shorter texts have no two periods of this scale
        at = flat.ranges(first[long], sizes[long] + 1)
        third = 3 * runs[2] <= scale
        places = synchronising_set(text, at, scale, (runs[0][third], runs[1][third]))
        place, period = _joined(_pairs(text, places, scale), _meeting(text, runs, scale))
        if len(place):
            runs = _primitive(_joined(runs, _extended(text, place, period, scale)))
        scale *= 2
    for start, length, period in zip(*runs):
        if not np.array_equal(spaced[start:start + length - period], spaced[start + period:start + length]):
            return find_runs(symbols, bounds, seed + 1)
    return runs[0] - (np.searchsorted(first, runs[0], "right") - 1), runs[1], runs[2]


def _repeats(ids, bounds):
    """For each word the place of the word that stands there: every tenth text, by its id's checksum, gets a
    tail that repeats its first words."""
    source = np.arange(bounds[-1])
    for k, (i, low, high) in enumerate(zip(ids, bounds[:-1], bounds[1:])):
        n = int(high - low)
        checksum = 1 if i is None else zlib.crc32(str(i).encode())
        if checksum % 10 == 0 and n:
            g = checksum // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            source[low + a:high] = low + a + np.arange(n - a) % period
    return source


def _runs_of_words(data, starts, ends, bounds):
    """Runs of LEAST words or more, by start and period."""
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data[flat.ranges(starts, ends - starts)])])
    symbols = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)
    start, length, period = find_runs(symbols, bounds)
    order = np.lexsort((period, start))
    order = order[length[order] >= LEAST]
    return start[order], length[order], period[order]


def _hash_of_words(data, starts, ends, bounds):
    """SHA-256 of every text's words joined by one space."""
    sizes = ends - starts + 1
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    packed = data[np.minimum(flat.ranges(starts, sizes), max(len(data) - 1, 0))]
    packed[places[1:] - 1] = 0x20
    raw, cuts = memoryview(packed.tobytes()), places[bounds]
    return [hashlib.sha256(raw[a:max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]


def _described(planted):
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text")):
                starts, ends, bounds = flat.words(data, offsets)
                ids = batch.column("doc_id").slice(first, n)
                if planted:
                    source = _repeats(ids.to_pylist(), bounds)
                    starts, ends = starts[source], ends[source]
                start, length, period = _runs_of_words(data, starts, ends, bounds)
                edges = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edges, start + period, 1)
                np.add.at(edges, start + length, -1)
                kept = np.cumsum(edges[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[bounds]
                of = np.searchsorted(start, bounds)
                local = start - bounds[np.searchsorted(bounds, start, "right") - 1]
                greatest, digests = [], []
                for low, high in zip(of[:-1], of[1:]):
                    rows = list(zip(local[low:high].tolist(), length[low:high].tolist(), period[low:high].tolist()))
                    greatest.append(max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None)))
                    digests.append(hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in rows).encode()).hexdigest())
                columns = [pa.array([g[k] for g in greatest], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(bounds)), pa.array(np.diff(of)), *columns,
                     pa.array([None if g[1] is None else 1000 * g[1] // g[2] for g in greatest], pa.int64()),
                     pa.array(np.diff(bounds) - np.diff(left)), pa.array(digests),
                     pa.array(_hash_of_words(data, starts[kept], ends[kept], left))],
                    ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "n_dropped",
                     "runs_sha256", "collapsed_sha256"])
    return run


def runs(documents, planted=False):
    """One row for each document: its words, its runs, the greatest of them (start, length, period and a thousand
    times its exponent), the words that collapsing drops (all of a run after its first period), and hashes of the
    list of runs and of the collapsed text. With `planted`, every tenth document is given repeats first, see `_repeats`."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _described(planted), f"doc_id {id_type}, n_words long, n_runs long, start long, length long, period long, "
        "exponent_milli long, n_dropped long, runs_sha256 string, collapsed_sha256 string")


def _listed(batches):
    for batch in batches:
        for first, n, data, offsets in flat.slices(batch.column("text")):
            starts, ends, bounds = flat.words(data, offsets)
            start, length, period = _runs_of_words(data, starts, ends, bounds)
            text = np.searchsorted(bounds, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, n).take(pa.array(text)), pa.array(start - bounds[text]),
                 pa.array(length), pa.array(period)], ["doc_id", "start", "length", "period"])


def listed_runs(documents):
    """doc_id, start, length and period of every run, as word numbers."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _listed, f"doc_id {id_type}, start long, length long, period long")

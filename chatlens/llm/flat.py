"""Texts of an Arrow batch as one flat byte array, with words, hashes and window minima over it.

Everything here is vectorised over a slice of a batch, so that Spark tasks spend their time in
numpy loops and hold a bounded number of bytes at once, whatever the number of rows.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_POWERS = 1 << 16

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~_SPACES
LETTERS = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    LETTERS[_low:_high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def byte_array(column):
    """Bytes and offsets of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) \
        else pa.large_string()
    column = column.cast(large)
    if column.null_count:
        column = pc.fill_null(column, b"" if large == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column, limit=SLICE_BYTES):
    """Yield (first row, rows, bytes, offsets) for runs of rows of about `limit` bytes, one row at least."""
    yield from blocks(*byte_array(column), limit)


def blocks(data, offsets, limit):
    """The same for bytes and offsets."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        low, high = offsets[first], offsets[last]
        yield first, last - first, data[low:high], offsets[first:last + 1] - low
        first = last


def words(data, offsets, inside=NOT_SPACE):
    """Start and end of every word, and for each text the place of its first word (one more at the end)."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)  # a text ends before the next starts
    edge[offsets] = True
    starts = np.flatnonzero(mask[1:] & (~mask[:-1] | edge))
    ends = np.flatnonzero(mask[:-1] & (~mask[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x):
    """Scramble 64-bit values in place of a second hash function."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Polynomial hash modulo 2**64 of any span from prefix sums; equal spans have equal hashes."""

    def __init__(self, seed):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._powers = {}

    def powers(self, n, base):
        known = self._powers.get(base)
        if known is None or len(known) < n:
            size = -(-n // _POWERS) * _POWERS
            known = np.ones(size, np.uint64)
            done = 1
            step = np.uint64(base)
            while done < size:
                known[done:2 * done] = known[:min(done, size - done)] * step
                step = np.uint64(int(step) * int(step) & (1 << 64) - 1)
                done *= 2
            self._powers[base] = known
        return known[:n]

    def prefix(self, symbols):
        """Prefix sums over bytes (looked up) or 64-bit symbols."""
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values), self.base), out=sums[1:])
        return sums

    def spans(self, sums, starts, ends):
        shift = self.powers(len(sums), self.inverse)
        length = (ends - starts).astype(np.uint64)
        return mix((sums[ends] - sums[starts]) * shift[starts] + length)

    def all_spans(self, sums, length):
        """Hash of the span of so many symbols at every place."""
        out = sums[length:] - sums[:-length]
        out *= self.powers(len(sums), self.inverse)[:len(out)]
        out += np.uint64(length)
        return mix(out)


@functools.cache
def rolling(seed):
    return Rolling(seed)


def word_hashes(data, starts, ends, seed=1):
    hasher = rolling(seed)
    return hasher.spans(hasher.prefix(data), starts, ends)


def owners(bounds):
    """For items dealt to texts by bounds: the text of each item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_minima(values, width):
    """Minimum of every full window of `width` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(values) - width + 1], out[width - have:])
    return out


def ranges(starts, lengths):
    """Concatenated arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_by_text(values, bounds):
    """Sum of the values of each text; texts without values have 0."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]

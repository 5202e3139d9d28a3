"""Packing: concatenate all token ids and cut them into sequences of a fixed length.

First pass: every task tokenises its documents and numbers their tokens from 0; the ids are written once,
so that a lost executor cannot change an order. The totals, one row a task, are summed up to the place of
each task in the whole. Second pass: every document is cut where its place crosses a multiple of the
length. Only the last sequence has padding.

Tokenising: distinct chunks of a slice are tokenised once. A chunk is a word, or where this is safe, a run
of letters, a digit or a run of punctuation, lower-cased: the tokenizer cuts there anyway. Words with other
than ASCII or Latin-1 letters, apostrophes, control characters or special tokens stay whole.

Defined cases: a NULL or empty text is its end id alone; rows with NULL or repeated ids are packed each;
other columns are ignored; an empty table gives no rows.
"""

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.llm.workers import thrifty
from chatlens.session import materialise

LENGTH = 2048
END_ID = 1
_SLICE = 8 << 20
_GROUP = 4096

_CLASS = np.zeros(256, np.uint8)  # 0: keep the word whole, 1: letter, 2: digit, 3: punctuation
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 0


@functools.cache
def _tokenizer(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        last[i] = token.endswith("</w>")
    return tokenizer, last


def _byte_classes(data):
    """Class of every byte; letters U+00C0 to U+00FF take two bytes, the first 0xC3."""
    kinds = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    follow = data[lead + 1]
    lead = lead[(follow != 0x97) & (follow != 0xB7)]
    kinds[lead] = 1
    kinds[lead + 1] = 1
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kinds[special] = 0
    return kinds


def chunks(data, offsets):
    """Chunks of a slice: starts, ends, whether safe, and bounds of each text; and the bytes to use."""
    starts, ends, _ = flat.words(data, offsets)
    kinds = _byte_classes(data)
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds == 0, out=odd[1:])
    safe = odd[starts] == odd[ends]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
    depth = np.zeros(len(data) + 1, np.int8)  # 1 inside safe words, after their first byte
    depth[starts[safe] + 1] += 1
    depth[ends[safe]] -= 1
    cut = np.flatnonzero(inner & (np.cumsum(depth[:-1], dtype=np.int8) == 1))
    first = np.sort(np.concatenate([starts, cut]))
    word = np.searchsorted(starts, first, "right") - 1
    last = ends[word]
    same = word[1:] == word[:-1]
    last[:-1][same] = first[1:][same]
    return first, last, safe[word], np.searchsorted(first, offsets)


def _distinct(data, starts, ends, safe):
    """Code of every chunk, and the distinct chunks with their safety; safe chunks are lower-cased."""
    lower = data.copy()
    at = flat.ranges(starts[safe], (ends - starts)[safe])
    lower[at] = flat.LOWER[data[at]]
    packed = lower[flat.ranges(starts, ends - starts)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    texts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed))
    coded = texts.dictionary_encode()
    code = coded.indices.to_numpy()
    kept = np.zeros(len(coded.dictionary), bool)
    kept[code] = safe
    return code.astype(np.int64), coded.dictionary.to_pylist(), kept


def _encode(tokenizer, last, texts, safe):
    """Ids of all texts one after another, and their counts. A safe chunk ends at the first word end."""
    counts = np.zeros(len(texts), np.int64)
    parts, order = [], []
    for simple in (True, False):
        chosen = np.flatnonzero(safe == simple)
        order.append(chosen)
        for low in range(0, len(chosen), _GROUP):
            group = chosen[low:low + _GROUP]
            if simple:
                joined = " ".join([texts[i] for i in group])
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
                stops = np.flatnonzero(last[ids]) + 1
                counts[group] = np.diff(stops, prepend=0)
                parts.append(ids)
            else:
                found = tokenizer.encode_batch_fast([texts[i] for i in group], add_special_tokens=False)
                for i, x in zip(group, found):
                    counts[i] = len(x.ids)
                    parts.append(np.array(x.ids, np.int64))
    order = np.concatenate(order)
    starts = np.zeros(len(texts), np.int64)
    starts[order] = np.cumsum(counts[order]) - counts[order]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), starts, counts


def tokenise(data, offsets, path):
    """Token ids of all texts of a slice, END_ID after each, and the bounds of each text."""
    tokenizer, last = _tokenizer(path)
    starts, ends, safe, bounds = chunks(data, offsets)
    code, texts, simple = _distinct(data, starts, ends, safe)
    ids, first, counts = _encode(tokenizer, last, texts, simple)
    ids = np.append(ids, END_ID)
    first, counts = np.append(first, len(ids) - 1), np.append(counts, 1)
    code = np.insert(code, bounds[1:], len(texts))  # the end of each text
    bounds = bounds + np.arange(len(bounds))
    sizes = np.zeros(len(code) + 1, np.int64)
    np.cumsum(counts[code], out=sizes[1:])
    return ids[flat.ranges(first[code], counts[code])], sizes[bounds]


def _tokenised(path):
    @thrifty
    def run(batches):
        part, place = TaskContext.get().partitionId(), 0
        wide = len(_tokenizer(path)[1]) > 1 << 16
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), _SLICE):
                ids, bounds = tokenise(data, offsets, path)
                raw = ids.astype(np.uint32 if wide else np.uint16).tobytes()
                width = 4 if wide else 2
                rows = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer(bounds * width), pa.py_buffer(raw)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.full(n, part)), pa.array(place + bounds[:-1]),
                     pa.array(np.diff(bounds)), pa.array(np.full(n, width), pa.int32()), rows],
                    ["doc_id", "part", "place", "doc_tokens", "width", "ids"],
                )
                place += int(bounds[-1])
    return run


def _pieces(length):
    @thrifty
    def run(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            tokens = batch.column("doc_tokens").to_numpy()
            first, last = place // length, (place + tokens - 1) // length
            row = np.repeat(np.arange(len(place)), last - first + 1)
            sequence = flat.ranges(first, last - first + 1)
            low = np.maximum(sequence * length, place[row])
            high = np.minimum((sequence + 1) * length, (place + tokens)[row])
            crc = np.zeros(len(row), np.int64)
            begin, end = low - place[row], high - place[row]
            owner = -1
            for k, r in enumerate(row):
                if r != owner:
                    owner = r
                    width = batch.column("width")[int(r)].as_py()
                    ids = np.frombuffer(batch.column("ids")[int(r)].as_buffer(), f"<u{width}").astype("<u4")
                crc[k] = zlib.crc32(ids[begin[k]:end[k]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(begin), pa.array(high - low), pa.array(crc),
                 pa.array(tokens[row]), pa.array(sequence), pa.array(low - sequence * length),
                 batch.column("total").take(pa.array(row))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "total"],
            )
    return run


def pack(documents, path, length=LENGTH):
    """One row for each piece of a document in a sequence, with the length its sequence is padded to."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    written = materialise(
        documents.select("doc_id", "text").mapInArrow(
            _tokenised(path), f"doc_id {id_type}, part long, place long, doc_tokens long, width int, ids binary"
        ), "tokens",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = written.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).select(  # one row a task
        "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shift"),
        F.sum("tokens").over(everything).alias("total"),
    )
    placed = written.join(F.broadcast(totals), "part").select(
        "doc_id", (F.col("place") + F.col("shift")).alias("place"), "doc_tokens", "width", "ids", "total"
    )
    pieces = placed.mapInArrow(
        _pieces(length), f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, total long",
    )
    used = F.least(F.lit(length), F.col("total") - F.col("sequence_id") * length)
    power = F.bit_count(used) == 1
    return pieces.select(
        *[c for c in pieces.columns if c != "total"],
        F.when(power, used).otherwise(F.lit(length)).cast("long").alias("padded_length"),
    )

"""Alignment of two tokenizers: which tokens of one cover the same bytes as which of the other, and how often.

A text with a space before it is cut into tokens by both. Byte offsets where tokens of both end cut it into groups;
all pairs of tokens of a group are linked. How many documents link an id pair is counted by external spilling:

1. Each task aligns slices of texts. The records (pair, document, links) of a slice are sorted by pair and written,
   divided by the radix of the A id, as one zstd run for each slice and radix: the pairs with their numbers of
   documents, and apart from them the documents. Nothing but the written folder passes between tasks.
2. Runs of one radix are merged, at most FAN_IN in a task, by a heap on (A id, B id) that adds up numbers of
   documents; the merged runs are merged again until one is left for each radix. Only the pairs are read for this.
   A pair that a third of all documents hold is one entry in each run, so no task gets more than others.
3. The last merge is in the order of A ids, so the greatest count of each A id is known as its pairs pass by.
4. The written documents of each run stream past the counts of its radix; what each document gets from that radix
   is added up over the radixes of its run. A radix with more than SHARE records is dealt to several tasks,
   each with a copy of that radix's counts.

Tokenising: distinct chunks of a slice are tokenised and aligned once. A chunk ends before a single space between
characters that are no white space: both tokenizers cut there whatever stands around (`_check` makes sure that the
pieces of B allow it), so groups don't reach across chunks.

Defined cases: NULL and empty texts, and texts that either tokenizer doesn't give back byte by byte, such as those
holding U+2581, have no tokens: all numbers are 0, groups_sha256 is ''. Rows with NULL or repeated ids are documents
of their own; other columns are ignored; an empty table gives no rows. Texts of any length are aligned whole; a text
longer than a slice is a slice of its own.
"""

import functools
import hashlib
import heapq
import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from chatlens.llm import flat
from chatlens.session import materialise

RADIXES = 64
FAN_IN = 64
SHARE = 8_000_000
_SLICE = 8 << 20
_GROUP = 4096
_MARK = "▁"

_PLAIN = np.zeros(256, bool)  # bytes of characters that are no white space; lead bytes of some spaces see below
_PLAIN[0x21:0x7F] = True
_PLAIN[0x80:] = True


def _byte_values():
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Vocabulary:
    """Bytes of every id, one after another."""

    def __init__(self, tokens):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens) or b"\0", np.uint8)

    def spelled(self, ids):
        return self.data[flat.ranges(self.starts[ids], self.lengths[ids])]


@functools.cache
def _tokenizer_a(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    values = _byte_values()
    known = tokenizer.get_vocab(with_added_tokens=False)
    tokens = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        tokens[i] = bytes(values[c] for c in token if c in values)
    return tokenizer, _Vocabulary(tokens)


def _check(model):
    for i in range(model.get_piece_size()):
        if _MARK in model.id_to_piece(i).lstrip(_MARK):
            raise ValueError("a piece of this model reaches across a space")


@functools.cache
def _tokenizer_b(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    _check(model)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else
                      b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(_MARK, " ").encode())
    return model, _Vocabulary(tokens)


def _cuts(data, offsets):
    """Places of single spaces between characters that are no white space, inside the texts."""
    plain = _PLAIN[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    plain[two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)] + 1] = False
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    lead, middle, last = data[three], data[three + 1], data[three + 2]
    space = ((lead == 0xE1) & (middle == 0x9A) & (last == 0x80)) | ((lead == 0xE3) & (middle == 0x80) & (last == 0x80))
    space |= (lead == 0xE2) & (middle == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    space |= (lead == 0xE2) & (middle == 0x81) & (last == 0x9F)
    at = three[space]
    plain[at] = plain[at + 2] = False
    plain[two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]] = False
    inner = np.zeros(len(data), bool)
    inner[1:-1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
    edge = np.concatenate([offsets[1:-1], offsets[1:-1] - 1])  # a space at either end of a text
    inner[edge[(edge >= 0) & (edge < len(data))]] = False
    return np.flatnonzero(inner)


def chunks(data, offsets):
    """Code of every chunk, first chunk of each text, and the distinct chunks. Each has a space before it, which is
    not part of it; an empty text has no chunk."""
    sizes = np.diff(offsets)
    cuts = _cuts(data, offsets) if len(data) else np.zeros(0, np.int64)
    starts = np.concatenate([offsets[:-1][sizes > 0], cuts + 1])
    starts.sort()
    bounds = np.searchsorted(starts, offsets)
    ends = np.append(starts[1:], len(data))
    cut = np.zeros(len(data) + 1, np.int64)
    cut[cuts + 1] = 1
    ends -= cut[ends]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    texts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[flat.ranges(starts, ends - starts)])])
    coded = pc.dictionary_encode(texts)
    return coded.indices.to_numpy().astype(np.int64), bounds, coded.dictionary.to_pylist()


def _encoded(texts, path_a, path_b):
    """Ids of both tokenizers for all chunks, one after another, and how many each chunk has."""
    a, b = _tokenizer_a(path_a)[0], _tokenizer_b(path_b)[0]
    found = ([], [])
    for low in range(0, len(texts), _GROUP):
        group = texts[low:low + _GROUP]
        found[0].extend(x.ids for x in a.encode_batch_fast([" " + t for t in group], add_special_tokens=False))
        found[1].extend(b.encode(group, num_threads=1))
    return [(np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)) for ids in found]


def _given_back(raw, ids, counts, vocabulary):
    """Which chunks the tokens spell byte by byte."""
    sizes = np.array([len(x) + 1 for x in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), counts)
    good = np.bincount(owner, vocabulary.lengths[ids], len(raw)).astype(np.int64) == sizes
    known = good[owner]
    left = vocabulary.spelled(ids[known])
    right = np.frombuffer(b"".join(b" " + x for x, g in zip(raw, good) if g), np.uint8)
    wrong = np.flatnonzero(left != right)
    places = np.cumsum(sizes[good])
    good[np.flatnonzero(good)[np.searchsorted(places, wrong, "right")]] = False
    return good


class Aligned:
    """Groups of the distinct chunks of a slice: ids of both sides, groups, and linked pairs."""

    def __init__(self, raw, path_a, path_b):
        texts = [x.decode("utf-8", "replace") for x in raw]
        sides = _encoded(texts, path_a, path_b)
        vocabularies = (_tokenizer_a(path_a)[1], _tokenizer_b(path_b)[1])
        self.good = np.ones(len(raw), bool)
        for (ids, counts), vocabulary in zip(sides, vocabularies):
            self.good &= _given_back(raw, ids, counts, vocabulary)
        kept = [ids[np.repeat(self.good, counts)] for ids, counts in sides]
        self.counts = [np.where(self.good, counts, 0) for _, counts in sides]
        ends = [np.cumsum(v.lengths[ids]) for ids, v in zip(kept, vocabularies)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        bounds = [np.concatenate([[0], np.searchsorted(e, cuts, "right")]) for e in ends]
        width = [np.diff(x) for x in bounds]
        chunk = np.repeat(np.arange(len(raw)), self.counts[0])[bounds[0][:-1]]  # of each group
        self.groups = np.bincount(chunk, minlength=len(raw))
        links = width[0] * width[1]
        group = np.repeat(np.arange(len(cuts)), links)
        place = flat.ranges(np.zeros(len(cuts), np.int64), links)
        a = kept[0][bounds[0][group] + place // np.maximum(width[1][group], 1)]
        b = kept[1][bounds[1][group] + place % np.maximum(width[1][group], 1)]
        self.links = np.bincount(chunk, links, len(raw)).astype(np.int64)
        self.pairs, self.pair = np.unique(((a % RADIXES) << 48) | (a << 24) | b, return_inverse=True)
        self.first = np.cumsum(self.links) - self.links
        self.spelled = self._spell(kept, bounds)

    def _spell(self, kept, bounds):
        a, b = ([*map(str, ids.tolist())] for ids in kept)
        low, high = bounds[0].tolist(), bounds[1].tolist()
        groups = [
            f"{a[low[k]] if low[k + 1] - low[k] == 1 else ','.join(a[low[k]:low[k + 1]])}|"
            f"{b[high[k]] if high[k + 1] - high[k] == 1 else ','.join(b[high[k]:high[k + 1]])}"
            for k in range(len(low) - 1)]
        ends = np.cumsum(self.groups).tolist()
        return [";".join(groups[e - n:e]) for e, n in zip(ends, self.groups.tolist())]


def _squeezed(*arrays):
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _pressed(data, *kinds):
    """Arrays of equal length, of the kinds given, from a run."""
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 40) if data else b""
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_WRITTEN = ("run long, radix int, ordinal int, doc_id {}, n_a long, n_b long, n_groups long, n_links long, "
            "groups_sha256 string, records long, pairs binary, documents binary")


def _runs(run, aligned, code, bounds, documents):
    """One row for each radix: pairs with numbers of documents, and the documents with numbers of links."""
    links = aligned.links[code]
    pair = aligned.pair[flat.ranges(aligned.first[code], links)]
    document = np.repeat(flat.owners(bounds), links)
    records, times = np.unique(pair * documents + document, return_counts=True)
    pair, document = records // documents, records % documents
    held, at, holders = np.unique(pair, return_index=True, return_counts=True)
    key = aligned.pairs[held]
    radix = key >> 48
    key &= (1 << 48) - 1
    edges = np.searchsorted(radix, np.arange(RADIXES + 1))
    at = np.append(at, len(pair))
    for r in np.flatnonzero(np.diff(edges)):
        low, high = edges[r], edges[r + 1]
        first, last = at[low], at[high]
        yield {"run": run, "radix": int(r), "records": int(last - first),
               "pairs": _squeezed(key[low:high], holders[low:high].astype(np.int64)),
               "documents": _squeezed(document[first:last].astype(np.int32), times[first:last].astype(np.int32))}


def _written(path_a, path_b, id_type):
    names = [x.split()[0] for x in _WRITTEN.format("long").split(", ")]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), _SLICE):
                code, bounds, raw = chunks(data, offsets)
                aligned = Aligned(raw, path_a, path_b)
                bad = flat.sums_by_text(~aligned.good[code], bounds) > 0
                sizes = np.where(bad, 0, np.diff(bounds))
                code = code[np.repeat(~bad, np.diff(bounds))]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                spelled = [aligned.spelled[c] for c in code]
                hashes = [hashlib.sha256(";".join(spelled[a:b]).encode()).hexdigest() if b > a else ""
                          for a, b in zip(bounds[:-1], bounds[1:])]
                ids = batch.column("doc_id").slice(first, n)
                base = {"run": pa.array(np.full(n, number)), "ordinal": pa.array(np.arange(n, dtype=np.int32)),
                        "doc_id": ids, "groups_sha256": pa.array(hashes)}
                for name, each in (("n_a", aligned.counts[0]), ("n_b", aligned.counts[1]),
                                   ("n_groups", aligned.groups), ("n_links", aligned.links)):
                    base[name] = pa.array(flat.sums_by_text(each[code], bounds).astype(np.int64))
                kinds = {"run": pa.int64(), "radix": pa.int32(), "ordinal": pa.int32(), "doc_id": ids.type,
                         "groups_sha256": pa.string(), "pairs": pa.binary(), "documents": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [base[c] if c in base else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names)
                rows = list(_runs(number, aligned, code, bounds, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.get(c) for r in rows], kinds.get(c, pa.int64())) for c in names], names)
                number += 1
    return run


def _merged(table):
    """One run from several of a radix; numbers of documents of equal pairs are added up."""
    streams = [zip(*(x.tolist() for x in _pressed(data.as_py(), np.int64, np.int64))) for data in table.column("pairs")]
    keys, counts, last = [], [], None
    for key, count in heapq.merge(*streams):
        if key == last:
            counts[-1] += count
        else:
            keys.append(key)
            counts.append(count)
            last = key
    return np.array(keys, np.int64), np.array(counts, np.int64)


def _merge(key, table):
    keys, counts = _merged(table)
    return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "member": pa.array([key[1].as_py()], pa.int64()),
                     "pairs": pa.array([_squeezed(keys, counts)], pa.binary())})


def pair_counts(runs, n_runs):
    """(radix, pairs): the runs merged to one for each radix, FAN_IN at a time."""
    counts = runs.select("radix", F.col("run").alias("member"), "pairs")
    left, name = n_runs, F.xxhash64("member")
    while True:
        left = math.ceil(left / FAN_IN)
        grouped = counts.withColumn("part", F.pmod(name, F.lit(left))).groupBy("radix", "part")
        counts = grouped.applyInArrow(_merge, "radix int, member long, pairs binary")
        if left <= 1:
            return counts.drop("member")
        counts, name = materialise(counts, "merged"), F.col("member")


def _given(key, runs, counts):
    """What the documents of some runs get from one radix."""
    keys, count = _pressed(counts.column("pairs")[0].as_py(), np.int64, np.int64)
    side = keys >> 24
    start = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))  # of each A id's pairs
    best = count == np.repeat(np.maximum.reduceat(count, start), np.diff(np.append(start, len(side))))
    out = {"run": [], "given": []}
    for run, pairs, held in zip(*(runs.column(c) for c in ("run", "pairs", "documents"))):
        pair, holders = _pressed(pairs.as_py(), np.int64, np.int64)
        document, times = _pressed(held.as_py(), np.int32, np.int32)
        at = np.repeat(np.searchsorted(keys, pair), holders)
        size = int(document.max()) + 1
        total = np.zeros(size, np.int64)
        np.add.at(total, document, count[at] * times)
        links = np.bincount(document, best[at] * times, size).astype(np.int64)
        out["run"].append(run.as_py())
        out["given"].append(_squeezed(total, links))
    return pa.table({"run": pa.array(out["run"], pa.int64()), "given": pa.array(out["given"], pa.binary())})


def _added(table):
    """One row for each document of a run, over all radixes."""
    parts = [_pressed(x.as_py(), np.int64, np.int64) for x in table.column("given")]
    size = max(len(t) for t, _ in parts)
    total, links = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for t, n in parts:
        total[:len(t)] += t
        links[:len(n)] += n
    return pa.table({"run": pa.array(np.full(size, table.column("run")[0].as_py())),
                     "ordinal": pa.array(np.arange(size, dtype=np.int32)), "n_best": pa.array(links), "count_sum": pa.array(total)})


def align(documents, path_a, path_b):
    """Tokens of both sides, groups and links of every document; how many of its links are among the most frequent of
    their A id; and over all its links the number of documents that hold the pair."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    written = materialise(
        documents.select("doc_id", "text").mapInArrow(_written(path_a, path_b, id_type), _WRITTEN.format(id_type)), "runs")
    base = written.where("radix IS NULL").select("run", "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    runs = written.where("radix IS NOT NULL")
    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    counts = materialise(pair_counts(runs, max(n_runs, 1)), "counts")
    sizes = runs.groupBy("radix").agg(F.sum("records").alias("n")).collect()  # RADIXES rows at most
    shares = F.lit(1).cast("long")
    for r in sizes:
        shares = F.when(F.col("radix") == r["radix"], F.lit(math.ceil(r["n"] / SHARE))).otherwise(shares)
    dealt = runs.select("run", "radix", "pairs", "documents").withColumn("share", F.pmod(F.xxhash64("run"), shares))
    copies = counts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
    given = dealt.groupBy("radix", "share").cogroup(copies.groupBy("radix", "share")).applyInArrow(
        _given, "run long, given binary")
    added = given.groupBy("run").applyInArrow(_added, "run long, ordinal int, n_best long, count_sum long")
    return base.join(added, ["run", "ordinal"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def _listed(table):
    keys, counts = _pressed(table.column("pairs")[0].as_py(), np.int64, np.int64)
    return pa.table({"a": pa.array(keys >> 24), "b": pa.array(keys & (1 << 24) - 1), "documents": pa.array(counts)})


def linked_pairs(documents, path_a, path_b):
    """Every linked pair of ids (a, b) and how many documents hold it: a dictionary from one tokenizer to the other."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    runs = materialise(
        documents.select("doc_id", "text").mapInArrow(_written(path_a, path_b, id_type), _WRITTEN.format(id_type)),
        "runs").where("radix IS NOT NULL")
    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    return pair_counts(runs, max(n_runs, 1)).groupBy("radix").applyInArrow(_listed, "a long, b long, documents long")

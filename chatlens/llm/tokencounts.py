"""Token counts of a unigram model by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word with the word mark before it. The distinct pre-tokens of a slice are sorted, so that
words with a common prefix are neighbours: level by level, each group that agrees up to there is one node
of the trie, and its forward score (best sum of piece scores so far) is computed once for all of them. At
the end of a pre-token its number of tokens is stored; a document's count is the sum over its words.

The vocabulary file holds merge ranks and no probabilities: the score of a piece is the logarithm of
1 / (rank + 1), in units of 1/10,000, so that sums are exact; of equal scores the one with fewer tokens
wins. A character that no piece covers counts as its UTF-8 bytes, at UNKNOWN_SCORE each.

No shuffle: tries live in tasks, one slice of text at a time.

Defined cases: NULL and empty texts have 0 words and 0 tokens; rows with NULL or repeated ids are counted
each; other columns are ignored.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chatlens.llm import flat

MARK = "▁"
UNKNOWN_SCORE = -200_000
_FILTER_BITS = 20
_SLICE = 8 << 20


def piece_scores(path):
    """Normal pieces of a vocabulary file and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -round(10_000 * float(np.log(rank + 2))) for rank, i in enumerate(pieces)}


@functools.cache
def _vocabulary(path):
    """Sorted hashes of the pieces, their scores, the longest length, and a filter on the low bits."""
    known = piece_scores(path)
    points = _points(list(known))
    lengths = np.array([len(p) for p in known])
    ends = np.cumsum(lengths)
    roller = flat.rolling(6)
    hashes = roller.spans(roller.prefix(points), ends - lengths, ends)
    order = np.argsort(hashes)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return hashes[order], np.array(list(known.values()), np.int64)[order], int(lengths.max()), seen


def _points(texts):
    """Code points of all texts one after another, scrambled to 64 bits."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.mix(raw.astype(np.uint64) + np.uint64(1))


def _lookup(hashes, scores, seen, wanted):
    """Scores of the wanted pieces, and which exist."""
    at = np.flatnonzero(seen[(wanted & np.uint64(len(seen) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(hashes, wanted[at]), len(hashes) - 1)
    hit = hashes[place] == wanted[at]
    return at[hit], scores[place[hit]]


def count_tokens(texts, path):
    """Token counts of pre-tokens that are sorted and distinct."""
    hashes, scores, longest, seen = _vocabulary(path)
    roller = flat.rolling(6)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    points = _points(texts)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (raw >= 0x80).astype(np.int64) + (raw >= 0x800) + (raw >= 0x10000)
    powers = roller.powers(int(lengths.max()) + 1, roller.base)
    inverse = roller.powers(int(lengths.max()) + 1, roller.inverse)
    tokens = np.zeros(len(texts), np.int64)
    # A level holds, for each node of one depth: best score, its tokens, hash so far, place of its parent.
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), None)]
    word, node = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    depth = 0
    while len(word):
        depth += 1
        symbol = points[starts[word] + depth - 1]
        new = np.ones(len(word), bool)
        new[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        parent = node[first]
        total = levels[-1][2][parent] + symbol[first] * powers[depth - 1]
        worth = width[starts[word[first]] + depth - 1]
        best, count = levels[-1][0][parent] + UNKNOWN_SCORE * worth, levels[-1][1][parent] + worth
        above = parent
        for size in range(1, min(depth, longest) + 1):
            level = levels[-size]
            wanted = flat.mix((total - level[2][above]) * inverse[depth - size] + np.uint64(size))
            at, score = _lookup(hashes, scores, seen, wanted)
            score, tokens_so_far = level[0][above[at]] + score, level[1][above[at]] + 1
            better = (score > best[at]) | ((score == best[at]) & (tokens_so_far < count[at]))
            best[at[better]], count[at[better]] = score[better], tokens_so_far[better]
            if level[3] is not None:
                above = level[3][above]
        node = np.cumsum(new) - 1
        done = lengths[word] == depth
        tokens[word[done]] = count[node[done]]
        levels = [*levels[-longest:], (best, count, total, parent)]
        word, node = word[~done], node[~done]
    return tokens


def _counted(path):
    def run(batches):
        for batch in batches:
            for first, n, data, offsets in flat.slices(batch.column("text"), _SLICE):
                starts, ends, bounds = flat.words(data, offsets)
                packed = data[flat.ranges(starts, ends - starts)]
                cuts = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(ends - starts, out=cuts[1:])
                coded = pa.LargeStringArray.from_buffers(
                    len(starts), pa.py_buffer(cuts), pa.py_buffer(packed)
                ).dictionary_encode()
                order = pc.sort_indices(coded.dictionary).to_numpy()
                tokens = np.zeros(len(order), np.int64)
                if len(order):
                    tokens[order] = count_tokens([MARK + t for t in coded.dictionary.take(order).to_pylist()], path)
                each = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(tokens[coded.indices.to_numpy()], out=each[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.diff(bounds)), pa.array(np.diff(each[bounds]))],
                    ["doc_id", "n_words", "n_tokens"],
                )
    return run


def token_counts(documents, path):
    """doc_id, n_words and n_tokens of every document."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        _counted(path), f"doc_id {id_type}, n_words long, n_tokens long"
    )

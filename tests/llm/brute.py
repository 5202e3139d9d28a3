"""Plain versions of the operators, and small tables with every odd case."""

import hashlib
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, node string, label int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

_BASE = [f"word{i % 97}x{i}" for i in range(160)]
_PASSAGE = [f"passage{i}" for i in range(60)]


def odd_rows():
    """NULL ids and texts, empty, short and long texts, equal rows, near copies, shared passages."""
    near = list(_BASE)
    near[40] = "changed"
    texts = [
        (1, " ".join(_BASE)), (2, " ".join(near)), (3, " ".join(_BASE)), (3, " ".join(_BASE)), (4, None), (5, ""),
        (6, "   \t\n"), (7, "one"), (8, "one two three"), (9, "One two THREE"), (None, " ".join(_BASE[:80])),
        (None, None), (10, "start " + " ".join(_PASSAGE) + " end ten"), (11, "other " + " ".join(_PASSAGE)),
        (12, "x" * 3000), (13, "\x00\x01 \x7f café 日本語 " + "\U0001F600" * 30), (14, "ab " * 400),
        (15, " ".join(f"unique{i}" for i in range(300))), (16, " ".join(_PASSAGE[:36])), (17, " ".join(near[:150])),
        (18, " ".join(_PASSAGE) + "\n" + " ".join(_PASSAGE)),
    ]
    return [(i, t, "en" if k % 2 else None, None, k, "clash", k, "clash", None) for k, (i, t) in enumerate(texts)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return [(r[0], r[1] or "") for r in rows]


def removed_words(documents, k=35):
    count = defaultdict(int)
    split = [(i, WORDS.findall(t)) for i, t in documents]
    for _, words in split:
        for j in range(len(words) - k + 1):
            count[tuple(words[j:j + k])] += 1
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for j in range(len(words) - k + 1):
            if count[tuple(words[j:j + k])] > 1:
                gone[j:j + k] = [True] * k
        kept = [w for w, g in zip(words, gone) if not g]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def removed_bytes(documents, k=50):
    last = 1 << 62
    first = {}
    for i, t in documents:
        raw = t.encode()
        for j in range(len(raw) - k + 1):
            s = raw[j:j + k]
            first[s] = min(first.get(s, last), last if i is None else i)
    out = []
    for i, t in documents:
        raw = t.encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - k + 1):
            if first[raw[j:j + k]] < (last if i is None else i):
                gone[j:j + k] = [True] * k
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k=5):
    words = WORDS.findall(text.translate(_LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[j:j + k]) for j in range(len(words) - k + 1)}


def linked(documents):
    sets = [shingles(t) for _, t in documents]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    by_token = defaultdict(list)
    for a, s in enumerate(sets):
        for t in s:
            by_token[t].append(a)
    for a, b in {(x, y) for g in by_token.values() for n, x in enumerate(g) for y in g[n + 1:]}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(documents):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a))) for a, (i, _) in enumerate(documents)]


def token_count(word, scores, mark, unknown):
    """Fewest tokens of the best segmentation."""
    word = mark + word
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + unknown * size, best[end - 1][1] - size)]
        options += [(best[j][0] + scores[word[j:end]], best[j][1] - 1) for j in range(max(0, end - 32), end)
                    if word[j:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def by_key(rows):
    """Rows in an order that NULLs allow."""
    return sorted(map(tuple, rows), key=repr)

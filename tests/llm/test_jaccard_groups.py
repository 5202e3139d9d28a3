"""A large group of near copies that share rare tokens, few of them linked."""

import brute
import numpy as np

from chatlens.llm import jaccard
from chatlens.llm.components import connected_components
from chatlens.session import materialise


def group(n, edits, size=150, seed=0):
    """Copies of one text, each with words of its own at random places."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"base{k}" for k in range(size)]
        for k in rng.choice(size, edits, replace=False):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def shared_rows(spark, rows):
    join = jaccard._Join(spark.createDataFrame(rows, "doc_id long, text string"))
    links = materialise(join.verify(jaccard._ordered(jaccard._star(join.postings)).distinct()), "links")
    roots = connected_components(links)
    return jaccard._shared_across(jaccard._mixed(join.postings, roots), join.bitmaps)


def test_rows_of_a_group_without_links_do_not_grow_with_its_square(spark):
    """A group twice as large has four times as many pairs; next to none of them is sent on."""
    for n in (60, 120):
        rows = shared_rows(spark, group(n, 9))
        assert rows.count() <= n


def test_links_inside_a_group_are_kept(spark):
    rows = group(40, 4, seed=1) + [(100 + i, t) for i, t in group(40, 6, seed=2)] + [(200 + i, t) for i, t in group(20, 1, size=900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    assert brute.by_key(jaccard.components(documents).collect()) == brute.by_key(brute.linked(rows))


def test_bitmaps_never_count_more_than_the_sets_differ():
    rng = np.random.default_rng(3)
    for n in (1, 40, 300, 2000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[n // 5:], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        a, b = (jaccard.signature(s).view(np.uint64) for s in (x, y))
        own = sum(int(w).bit_count() for w in a & ~b)
        assert own <= len(np.setdiff1d(x, y))

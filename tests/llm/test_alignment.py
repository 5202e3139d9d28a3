"""Alignment of two tokenizers against a plain version on whole texts."""

import hashlib
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chatlens.llm import alignment
from chatlens.llm.queries import BYTE_BPE, PIECES, QUERIES

A, B = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text; whole texts, one after another."""
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    codes = alignment._byte_values()
    spelling = {i: bytes(codes.get(c, 0) for c in t) for t, i in left.get_vocab().items()}
    documents, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            pieces = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i)
                      else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(spelling[i] for i in a) == b"".join(pieces) == (" " + text).encode():
                cut_a, cut_b, group = [0], [0], ([], [])
                for i in a:
                    cut_a.append(cut_a[-1] + len(spelling[i]))
                for p in pieces:
                    cut_b.append(cut_b[-1] + len(p))
                ends = set(cut_a) & set(cut_b)
                m = 0
                for i, end in zip(a, cut_a[1:]):
                    group[0].append(i)
                    if end in ends:
                        while cut_b[m] < end:
                            group[1].append(b[m])
                            m += 1
                        groups.append(group)
                        group = ([], [])
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        held.update(set(links))
        documents.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in documents:
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out, held


ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "a\nb", "a \n b", "tab\tand space ", "no break and  x 　 y",
    "thin space a  b   c", "next\u0085line \u0085 x", "mark ▁ in text", "a▁b c", "<|endoftext|> </s> <s> <unk> <0x41>",
    "café 日本語のテキスト 漢字", "\U0001F600\U0001F469‍\U0001F469‍\U0001F467 fam", "it's we'll 'tis 1234567 3.14159", "x" * 500,
    "\x00\x01\x7f \x00", "ﬁne ligature ① Ⅷ é", "e" + "́" * 5 + " z", "१२३ ๑๒๓ עברית العربية", " ​ zero ﻿ bom", "¡Hola! ¿Qué? «sí»",
    "the the the the the", "The THE the, (the) the.", "1 2 3 \r\n4", "a" * 3 + " " * 20 + "b",
]


@pytest.mark.parametrize("fan_in,share", [(64, 8_000_000), (2, 3)])
def test_odd_texts(spark, monkeypatch, fan_in, share):
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "SHARE", share)
    rows = list(enumerate(ODD)) + [(None, "the the end"), (3, "a"), (3, "a"), (None, None)] + [
        (100 + k, f"the same words for a third of all documents {k % 5}") for k in range(20)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = plain([t for _, t in rows])[0]
    got = alignment.align(documents, A, B).collect()
    assert brute.by_key(got) == brute.by_key((i, *w) for (i, _), w in zip(rows, want))
    assert any(w[4] < w[3] for w in want) and sum(w[6] == "" for w in want) >= 4


def test_pairs(spark):
    texts = [t for t in ODD if t] * 2
    got = alignment.linked_pairs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), A, B)
    assert {(r["a"], r["b"]): r["documents"] for r in got.collect()} == plain(texts)[1]


def test_clashing_columns_and_empty_table(spark):
    rows = brute.odd_rows()
    got = alignment.align(brute.odd(spark), A, B).collect()
    assert brute.by_key(got) == brute.by_key((r[0], *w) for r, w in zip(rows, plain([r[1] for r in rows])[0]))
    assert alignment.align(brute.empty(spark), A, B).collect() == []
    assert alignment.linked_pairs(brute.empty(spark), A, B).collect() == []


def test_given_documents(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_token_alignment"](spark, tiny).collect()
    assert brute.by_key(got) == brute.by_key((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows])[0]))


def test_very_long_texts_and_text_ids(spark):
    texts = ["long " * 400_000, "y" * 300_000, "日本" * 100_000]
    documents = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    want = plain(texts)[0]
    assert sorted(map(tuple, alignment.align(documents, A, B).collect())) == [(f"d{i}", *w) for i, w in enumerate(want)]

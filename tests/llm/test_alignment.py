"""Two tokenizers aligned, against the libraries and a plain merge."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fiscalarc.llm import alignment
from fiscalarc.llm.queries import tokenizer_path
from fiscalarc.llm.tokens import _AS_TEXT

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, links long, n_a string"


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def plain(texts, coders):
    """Per text: ids of both and the groups, by a merge of byte ends."""
    a, b = coders
    back = {c: x for x, c in _AS_TEXT.items()}
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in ids_b for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], []))
            continue
        ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
        ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            ia, jb = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[i:ia], ids_b[j:jb]))
            i, j = ia, jb
        out.append((ids_a, ids_b, groups))
    return out


def texts():
    rng = random.Random(11)
    letters = "abcdeé ñüß.,!0123\n\t  日本😀▁'-<|>"
    out = [None, "", " ", "  ", "\n", "a", " leading", "trailing ", "two  spaces   three", "x   y",
           "a   b", "<|endoftext|> and <s> </s> <unk> <0x41>", "don't we'll", "snake_case camelCase",
           "▁", "a▁b", "tab\t x", "line \n  next", "é combining", "ﬁ Ⅷ", "   z", "\u0000 nul"]
    for _ in range(60):
        out.append("".join(rng.choices(letters, k=rng.choice((3, 20, 200)))))
    words = ["the", "quick", "brown", "Straße", "niño", "été", "2024", "end.", "scum"]
    out += [" ".join(rng.choices(words, k=n)) for n in (5, 50, 4000)]
    return out + out[-2:]


def test_alignment(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "BUFFER", 100)
    data = [(i % 80 if i % 7 else None, t, 5, "x") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = plain([r[1] for r in data], coders)
    counts = Counter((a[-1], b[-1]) for _, _, groups in found for a, b in groups)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    want = []
    for (i, *_), (ids_a, ids_b, groups) in zip(data, found):
        links = [(a[-1], b[-1]) for a, b in groups]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        want.append((i, len(ids_a), len(ids_b), len(groups), len(links),
                     sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    got = alignment.alignment(docs, tokenizer_path(), PIECES)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(not w[1] for w in want) > 4 and alignment.alignment(
        docs.limit(0), tokenizer_path(), PIECES).collect() == []


def test_lists_are_whole(spark, coders):
    data = [(i, t, 1, "") for i, t in enumerate(texts())]
    found = plain([r[1] for r in data], coders)
    for r in alignment.align(spark.createDataFrame(data, SCHEMA), tokenizer_path(), PIECES).collect():
        ids_a, ids_b, groups = found[r.doc_id]
        assert (r.a_ids, r.b_ids) == (ids_a, ids_b)
        assert r.a_upto == np.cumsum([len(a) for a, _ in groups]).tolist()
        assert r.b_upto == np.cumsum([len(b) for _, b in groups]).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.integers(0, 2**30)), max_size=6))
def test_lockstep(documents):
    ends_a, ends_b, last, base = [], [], [], 0
    for sizes, seed in documents:
        total, rng = sum(sizes), random.Random(seed)
        ends_a += (base + np.cumsum(sizes)).tolist()
        ends_b += sorted(base + e for e in {*rng.sample(range(1, total + 1), rng.randint(1, total)), total})
        base += total
        last.append(base)
    for lane in (1, 7, 10**6):
        alignment.LANE, before = lane, alignment.LANE
        try:
            a, b = alignment.lockstep(*(np.array(x, np.int64) for x in (ends_a, ends_b, last)))
        finally:
            alignment.LANE = before
        both = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[i] for i in a] == [ends_b[i] for i in b] == both

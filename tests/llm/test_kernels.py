"""The pieces of the operators that need no session, against plain versions."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fiscalarc.llm import ecoc, fmindex, jaccard, kneserney, nnpu, packing, resampling, simple8b
from fiscalarc.llm.queries import tokenizer_path
from fiscalarc.llm.tagpaths import main_text
from fiscalarc.llm.text import ALNUM, SPACED, blocks, mix, pack_sorted, unpack_sorted, word_hashes
from fiscalarc.llm.tokens import Coder

TEXTS = ["", None, "one", "a b  c\n\nd", " lead", "trail ", "É à ß 日本", "A\x00b", "x" * 5000, "a\tb\x0bc"]


def test_words_match_the_patterns():
    for inside, pattern in ((SPACED, rb"[^\x20\x09-\x0D]+"), (ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        hashes, row = word_hashes(pa.array(TEXTS), inside)
        lowered = [bytes(b + 32 if 65 <= b < 91 else b for b in (t or "").encode()) for t in TEXTS]
        want = [(i, w) for i, t in enumerate(lowered) for w in re.findall(pattern, t)]
        assert row.tolist() == [i for i, _ in want]
        names = {}
        for h, (_, w) in zip(hashes.tolist(), want):
            assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_blocks_cover_all_rows_once():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])
    assert [t for b in blocks(batch, 0, 10) for t in b.column(0).to_pylist()] == TEXTS


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True))
def test_packed_hashes_come_back(values):
    array = np.array(sorted(values), np.uint64)
    assert (unpack_sorted(pack_sorted(array)) == array).all()
    assert (kneserney.unmix(mix(array)) == array).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 70000), st.integers(0, 3)), max_size=700))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint32)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all()
    if len(ids) > simple8b.BLOCK_IDS:  # a block is decoded alone
        part = simple8b.decode(words[offsets[0]:offsets[1]], offsets[:2] - offsets[0], simple8b.BLOCK_IDS)
        assert (part == ids[:simple8b.BLOCK_IDS]).all()
    content = simple8b.segment(np.array([7]), np.array([len(ids)]), ids)
    docs, sizes, back = next(simple8b.segments(content))
    assert docs.tolist() == [7] and sizes.tolist() == [len(ids)] and (back == ids).all()


def test_token_ids_are_the_tokenizers():
    coder = Coder(tokenizer_path())
    texts = [t for t in TEXTS] + [
        "a  b", "a\n\nb", "x.\ny z\n", "it's a's", "don't stop, it's", "a!!\nB!! c**", "12 3a a3, .",
        "<|endoftext|> hi<|endoftext|>", "　 a \x85 b", "a\x7f b", "tab\t x", "ª º x", "a ​ b",
        "Thnd*** of%%% the&&& Rréè üß, é. d'un"]
    ids, at = coder.column(pa.array(texts))
    for i, text in enumerate(texts):
        want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i]:at[i + 1]].tolist() == want, text
    again, _ = coder.column(pa.array(texts))
    assert (again == ids).all()


def _best_fit(lengths, window):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    rows = packing.plan(Counter(lengths), 32)
    assert Counter({n: sum(r[2] for r in rows if r[0] == n) for n in set(lengths)}) == Counter(lengths)
    filled = {}
    for length, first, many, sequence, offset in rows:
        for k in range(many):
            filled.setdefault(sequence + k, []).append((offset, length))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 32
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(32 - sum(n for _, n in p) for p in filled.values()) == _best_fit(lengths, 32)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_suffix_array_and_search(symbols):
    text = np.array(symbols + [0])
    assert fmindex.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = fmindex.FMIndex(text)
    for pattern in ([1], [1, 2], [2, 2], [1, 2, 3], [4, 4, 4]):
        phrases = fmindex.Phrases([], 10)
        phrases.symbols, phrases.length = np.array([pattern]), np.array([len(pattern)])
        phrases.longest = len(pattern)
        _, found = index.search(phrases)
        want = [i for i in range(len(text) - len(pattern) + 1) if text[i:i + len(pattern)].tolist() == pattern]
        assert sorted(found.tolist()) == want


def test_scan_against_plain_search():
    rng = random.Random(3)
    words = "aa bb cc dd ee ff".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(40)] + [None, ""]
    items = [(str(i), " ".join(rng.choices(words[:3], k=k))) for i, k in enumerate((1, 2, 4, 7, 12))] + [("n", None)]
    phrases = fmindex.Phrases(items, 4)
    n_words, spans, pairs, _ = fmindex.scan(pa.array(texts), phrases)
    for t, text in enumerate(texts):
        own = (text or "").split()
        hit, found = set(), set()
        for i, (_, item) in enumerate(items):
            w = (item or "").split()
            size = min(4, len(w))
            for k in range(len(w) - size + 1 if size else 0):
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == w[k:k + size]:
                        hit.update(range(at, at + size))
                        found.add(i)
        first = int(n_words[:t].sum())
        assert {x - first for r, a, b in spans.tolist() if r == t for x in range(a, b)} == hit
        assert {i for r, i in pairs.tolist() if r == t} == found


def test_sets_and_slack():
    row, shingle = jaccard.sets_of(pa.array(["a b c d e f a b c d e f", "A b", "", None, "a b c d e"]))
    assert np.bincount(row, minlength=5).tolist() == [6, 1, 0, 0, 1]
    for n in range(1, 400):
        need = min(math.ceil(75 * max(n, m) / 100) for m in range(n, n + 1))
        assert jaccard.slack(n) == n - need


def test_codewords_differ():
    for n in (1, 2, 3, 4, 5, 6, 12, 40):
        code = ecoc.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


def test_languages_without_rows_or_letters():
    texts = pa.array(["the of and to the of", "der die das und der die", "123 ...", "", None])
    counts = np.zeros((2, ecoc.BUCKETS))
    index, row = ecoc.gram_index(texts)
    for lang, t in ((0, 1), (1, 0)):
        counts[lang] = np.bincount(index[row == t], minlength=ecoc.BUCKETS)
    model = ecoc.Model(["de", "en"], counts)
    best, score, _ = model.decode(model.margins(texts))
    assert [model.langs[b] for b in best[:2]] == ["en", "de"] and (score <= 1).all()
    assert ecoc._lettered(texts).tolist() == [True, True, False, False, False]


def test_non_negative_learning_finds_toxic_words():
    rng = random.Random(5)
    common = [f"word{i}" for i in range(300)]
    toxic = [" ".join(rng.choices(common, k=40) + ["idiot", "scum"]) for _ in range(60)]
    clean = [" ".join(rng.choices(common, k=40)) for _ in range(300)]
    def rows(texts):
        key, row = nnpu.features(pa.array(texts))
        return [np.unique(key[row == i]) for i in range(len(texts))]
    model = nnpu.fit(rows(toxic[:40]), rows(toxic[40:] + clean[:200]), prior=20 / 220)
    score = model.score(pa.array(toxic[40:] + clean[200:] + ["", None]))
    assert (score[:20] >= 0.5).all() and (score[20:] < 0.5).all()
    assert (nnpu.fit([], [], 0.1).score(pa.array(["idiot"])) < 0.5).all()


def test_discounts_stay_inside_counts():
    for counts in ((10, 5, 3, 2), (0, 0, 0, 0), (1, 0, 0, 0), (3, 9, 9, 9)):
        for i, d in enumerate(kneserney.discounts(*counts), 1):
            assert 0 < d <= i


def test_shapes_see_form_not_topic():
    index, row = resampling.shape_index(pa.array(["Foo bar, baz.", "Xyz abc, def.", "FOO!! BAR!!", "", None]))
    found = [sorted(index[row == i].tolist()) for i in range(5)]
    assert found[0] == found[1] and found[2] != found[0] and found[3] == found[4] == []


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav>"
     "<article><h1>Title</h1><p><b>First,\n  paragraph.<br><p>Second &eacute; one.</p>"
     "<script>var t='</p>';</script></article><footer>foot</footer></body></html>",
     "Title\n\nFirst, paragraph.\n\nSecond é one."),
    ("<body><div class=menu>m</div><div id=main><p>Long text, with marks.</p><p>More, of it.</p>"
     "<div class='comments'><p>Nice, really.</p></div></div><form>f</form></body>",
     "Long text, with marks.\n\nMore, of it."),
    ("<article><p>a < b and <i>c</i>d.</p><!-- x --></article>", "a < b and cd."),
    ("<article><ul><li>one, a<li>two, b</ul></article>", "one, a\n\ntwo, b"),
    ("<nav>only menu</nav>", ""), ("<p>a <a href='q", "a <a href='q"),
])
def test_main_text(page, want):
    assert main_text(page) == want


LONG = "A sentence of some words, with marks, and more of it. " * 6


@pytest.mark.parametrize("page,want", [
    (f"<article><h1>Title</h1><p>Lead, short.</p><div class=body><p>{LONG}</p></div></article>",
     ["Title", "Lead, short.", LONG]),
    (f"<body><div><section><p>{LONG * 6}</p></section><section><p>{LONG}</p></section></div></body>",
     [LONG * 6, LONG]),
    (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article><p>foot</p>", [LONG, LONG]),
    (f"<body><div class=menu>m</div><div><p>{LONG}</p><p><a href=x>All a link, really.</a></p><p>{LONG}</p>"
     "<ul><li><a href=y>Reference</a></li></ul></div></body>",
     [LONG, "All a link, really.", LONG, "Reference"]),
    (f"<body><ul><li><a href=x>Home</a></ul><p>{LONG}</p><p><a href=x>Linked, yes.</a></p><p>{LONG}</p>"
     "<ul><li><a href=x>Next</a></ul></body>", [LONG, "Linked, yes.", LONG]),
])
def test_main_text_keeps_the_whole_article(page, want):
    assert main_text(page) == "\n\n".join(" ".join(x.split()) for x in want)


@pytest.mark.parametrize("attrs", [
    "style='overflow:hidden'", "title='hidden gems'", "class='content no-sidebar'", "class=has-sidebar",
    "class='post comments-open'", "class=article-header", "data-x='class=menu'", "class=sidebar-left",
    "id=search", "hidden"])
def test_main_text_inside_a_wrapper(attrs):
    text = " ".join(LONG.split())
    for page in (f"<div {attrs}><p>{LONG}</p></div>", f"<div {attrs}><article><p>{LONG}</p></article></div>"):
        assert main_text(f"<body><div class=menu>Menu, short.</div>{page}</body>") == text


@pytest.mark.parametrize("attrs", [
    "hidden", "HIDDEN=''", "class='x ad'", "id=site-footer", "class=cookie-banner", "class='comments-area'",
    "role=search", "class=side-bar", "class=related_posts"])
def test_main_text_without_named_parts(attrs):
    part = f"<div {attrs}><article><p>{LONG * 3}</p></article></div>"
    assert main_text(f"<main><p>{LONG}</p></main>{part}") == " ".join(LONG.split())
    assert main_text(f"<div><p>{LONG}</p></div><div {attrs}><p>{LONG[:60]}</p></div>") == " ".join(LONG.split())
    page = f"<form><header><main><p>{LONG}</p></main></header></form>"
    assert main_text(page) == " ".join(LONG.split())


def test_words_are_encoded_once_with_and_without_marks():
    coder, met = Coder(tokenizer_path()), []
    plain = coder._encode
    coder._encode = lambda pieces: met.extend(pieces) or plain(pieces)
    texts = ["one two two. two, two! two 9 9; don't.x's! a.'s \u00e9.. b.", "two; two?! \u2014. a b.c", None, ""]
    ids, at = coder.column(pa.array(texts))
    for i, text in enumerate(texts):
        want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[at[i]:at[i + 1]].tolist() == want
    assert [p for p in met if p.startswith(" two")] == [" two"]


def test_simple8b_takes_the_densest_selector():
    rng = np.random.default_rng(6)
    for n in (1, 59, 128, 129, 700):
        ids = (rng.integers(0, 1 << 32, n) >> rng.choice([0, 1, 12, 20, 28, 31], n)).astype(np.uint32)
        ids[n // 3:n // 2] = 1
        want, i = [], 0
        while i < n:
            end = min(n, (i // simple8b.BLOCK_IDS + 1) * simple8b.BLOCK_IDS)
            s, count = next(((s, c) for s, (c, b) in enumerate(simple8b.SELECTORS)
                             if ids[i:min(i + c, end)].max() < 1 << b), (simple8b.ESCAPE, 1))
            want.append(s)
            i = min(i + count, end)
        assert (simple8b.encode(ids)[0] & np.uint64(15)).tolist() == want


@pytest.mark.parametrize("mapper", [jaccard._marks, jaccard._whole_sets])
def test_sets_are_made_of_small_blocks(monkeypatch, mapper):
    whole, sizes = jaccard.sets_of, []
    monkeypatch.setattr(jaccard, "sets_of", lambda texts: sizes.append(
        sum(map(len, texts.to_pylist()))) or whole(texts))
    batch = pa.RecordBatch.from_pydict({"doc_id": range(1000), "text": [f"a{i} b c d e f " * 60 for i in range(1000)]})
    assert sum(b.num_rows for b in mapper([batch])) == 1000
    assert max(sizes) <= 1 << 18 and sum(sizes) > 1 << 19


def near_list(n_docs, rng, shingles=150, copies=1):
    """A list of near copies as ``_near`` gets it: each set lacks a few shingles of the same text."""
    base, maps, size = rng.integers(0, 2**63, shingles, dtype=np.uint64), [], []
    for _ in range(n_docs):
        mine = base[:shingles - int(rng.integers(0, 10))].copy()
        mine[rng.integers(0, len(mine), 6)] = rng.integers(0, 2**63, 6, dtype=np.uint64)
        odd = np.bincount((mine % np.uint64(512)).astype(np.int64), minlength=512) & 1
        maps.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        size.append(len(mine))
    return pa.table({"doc": rng.permutation(n_docs), "n": np.array(size), "bits": pa.array(maps, pa.binary()),
                     "component": np.arange(n_docs) // copies, "block": np.zeros(n_docs, np.int32)})


@pytest.mark.parametrize("edges", [1, 37, 1 << 16])
def test_a_list_gives_the_least_spanning_forest(monkeypatch, edges):
    monkeypatch.setattr(jaccard, "EDGES", edges, raising=False)
    for seed in range(4):
        table = near_list(60, np.random.default_rng(seed), copies=1 + seed % 3)
        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        pairs = []
        for i, x in enumerate(rows):
            for y in rows[i + 1:]:
                apart = (int.from_bytes(x["bits"], "little") ^ int.from_bytes(y["bits"], "little")).bit_count()
                total = x["n"] + y["n"]
                need = -(-75 * total // 175)
                if 75 * y["n"] <= 100 * x["n"] and apart <= total - 2 * need and x["component"] != y["component"]:
                    pairs.append((apart, len(pairs), x, y))
        group, forest = {r["component"]: r["component"] for r in rows}, set()
        for _, _, x, y in sorted(pairs, key=lambda p: p[:2]):
            a, b = group[x["component"]], group[y["component"]]
            if a != b:
                forest.add(tuple(sorted((x["doc"], y["doc"]))))
                group = {k: a if v == b else v for k, v in group.items()}
        assert len(forest) > 10
        for tree, want in ((True, forest), (False, {tuple(sorted((x["doc"], y["doc"]))) for *_, x, y in pairs})):
            a, b = jaccard._near(table, tree)
            assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_the_forest_of_a_list_holds_few_pairs():
    table = near_list(800, np.random.default_rng(1))
    tracemalloc.start()
    jaccard._near(table, True)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 25


def test_pairs_of_many_lists_come_once():
    some = np.array([3, 1, 3], np.int64), np.array([4, 2, 4], np.int64)
    a, b = jaccard._distinct([some, some])
    assert (a.tolist(), b.tolist()) == ([1, 3], [2, 4])
    assert [len(x) for x in jaccard._distinct([])] == [0, 0]

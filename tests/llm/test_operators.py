"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fiscalarc.llm import (
    divergence,
    ecoc,
    fmindex,
    jaccard,
    kneserney,
    nnpu,
    packing,
    resampling,
    simple8b,
    tagpaths,
)
from fiscalarc.llm.components import components
from fiscalarc.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, key string, good boolean"


def lowered(text):
    return bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode())


def words(text):
    return WORD.findall(lowered(text))


@pytest.fixture(scope="module")
def corpus():
    """Texts of every odd kind, exact copies, near copies, a common passage, a repeated row."""
    rng = random.Random(17)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "é", "Ünd"]
    passage = " ".join(rng.choices(vocabulary, k=40))
    texts = [None, "", " \n ", "one", "One", "a b", "x." * 3000, "the the the " * 40]
    for _ in range(60):
        texts.append(" ".join(rng.choices(vocabulary, k=rng.choice((3, 5, 6, 12, 30, 80, 300)))))
    for _ in range(30):
        base = rng.choice(texts[8:68]).split()
        for _ in range(rng.randrange(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [texts[9]] * 5 + [texts[20] + " " + passage, texts[21] + "\n" + passage, passage]
    star = rng.choices(vocabulary, k=120)
    for _ in range(40):
        copy = list(star)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, rng.choice(("en", "de", None)), 7, "k", True) for i, t in zip(ids, texts)]
    return rows + [rows[30]]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


@pytest.mark.parametrize("limits", [{}, {"SEND": 1e-9}, {"SEND": 1e9, "LIST_BLOCK": 8}])
def test_jaccard_join(docs, corpus, monkeypatch, limits):
    for name, value in limits.items():  # all light, all heavy with lists in blocks
        monkeypatch.setattr(jaccard, name, value)
    found, links = jaccard.join(docs)
    sets = {r[0]: shingles(r[1]) for r in corpus}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    rows = found.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root(r.doc_id))
    for a, b in links.collect():
        both = len(sets[a] & sets[b])
        assert 100 * both >= 75 * len(sets[a] | sets[b])


def test_jaccard_join_of_nothing(none):
    assert jaccard.join(none)[0].count() == 0


@pytest.mark.parametrize("few", [100_000, 20])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr("fiscalarc.llm.components.FEW", few)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_contamination(spark, docs, corpus, none, monkeypatch):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, corpus[20][1]), (2, None), (3, "one"), (10, corpus[40][1]), (11, corpus[40][1]), (4, "")]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lowered(t))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[k:k + size])].add(i)
    sizes = {len(w) for w in windows}

    def want(text):
        w, hit, own = pattern.findall(lowered(text)), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    own |= windows[tuple(w[k:k + size])]
        key = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
        return len(w), len(hit), len(own), key, bool(hit)

    texts = {r[0]: r[1] for r in corpus}
    for sliced in (False, True):
        if sliced:
            monkeypatch.setattr(fmindex, "SLICE_WORDS", 20)
        rows = fmindex.contamination(docs, benchmark).collect()
        for r in rows:
            assert tuple(r)[1:6] == want(texts[r.doc_id])
            assert sum(s["last"] - s["first"] for s in r.spans) == r.n_hit
    assert fmindex.contamination(none, benchmark).count() == 0
    empty = fmindex.contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert empty == 0


def test_contamination_in_slices_keeps_every_row(spark, monkeypatch):
    item = [" ".join(f"{c}{i}" for i in range(10)) for c in "abcdefgh"]
    rows = [(i, f"{x} {item[k]} y {item[k - 1]}") for k in range(8)
            for i in (None, 1, k) for x in ("x", "x", "z z")]
    docs = spark.createDataFrame([*rows, (None, None), (1, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    whole = fmindex.contamination(docs, benchmark).collect()
    monkeypatch.setattr(fmindex, "SLICE_WORDS", 10)
    sliced = fmindex.contamination(docs, benchmark).collect()
    assert len(whole) == len(sliced) == len(rows) + 2
    assert sorted(map(str, whole)) == sorted(map(str, sliced))


def test_packing(docs, corpus, none):
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    window, rows = 64, packing.pack(docs, tokenizer_path(), 0, 64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = {r[0]: r[1] for r in corpus}
    for doc_id, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(r[0] == doc_id for r in corpus)
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start)[::copies]:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and len(by_doc[doc_id]) == copies * -(-len(ids) // window)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_token_files(spark, docs, corpus, none):
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    uri, files = simple8b.write_ids(docs, tokenizer_path(), 2)
    assert files.agg(F.sum("n_docs")).first()[0] == len(corpus)
    rows = sorted(simple8b.read_ids(spark, uri, files).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc_id, text, *_) in zip(rows, sorted(corpus, key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    uri, files = simple8b.write_ids(none, tokenizer_path(), 2)
    assert simple8b.read_ids(spark, uri, files).count() == 0


def test_token_files_of_rows_without_an_id(spark):
    big = 2**53 + 1
    rows = [(None, "b c"), (big, "a"), (None, None), (-big, "d e f"), (big + 1, "g"), (None, "a")]
    uri, files = simple8b.write_ids(
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path(), 2)
    found = sorted(simple8b.read_ids(spark, uri, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, None, -big, big, big + 1]
    assert found[0].n_tokens == 1


def test_quality_rules(docs, corpus, none):
    plain = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {r[0]: r[1] or "" for r in corpus}
    found = divergence.quality(docs).collect()
    assert len(found) == len(corpus)
    for r in found:
        text, w = texts[r.doc_id], plain.findall(texts[r.doc_id])
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        hit = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if plain.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.kept and r.base_failed) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1
    assert divergence.quality(none).count() == 0


def test_jensen_shannon_distance(spark):
    row = spark.createDataFrame([([1, 3, 0], [2, 0, 2], [0, 0, 0])],
                                "p array<long>, q array<long>, z array<long>")
    d, same, empty = row.select(divergence.distance("p", "q"), divergence.distance("p", "p"),
                                divergence.distance("p", "z")).first()
    p, q = (0.25, 0.75, 0.0), (0.5, 0.0, 0.5)
    want = math.sqrt(sum(x * math.log2(2 * x / (a + b)) / 2 for a, b in zip(p, q) for x in (a, b) if x))
    assert abs(d - want) < 1e-12 and same == empty == 0


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>A,  b.</p></article>", "x"), (2, None, None, "x"),
                                   (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, tagpaths.extract(pages).collect()), key=str) == [
        (1, "u", "", 0), (1, "u", "A, b.", 5), (2, None, "", 0)]
    assert tagpaths.extract(pages.limit(0)).count() == 0


def test_word_model(docs, corpus, none):
    training = docs.filter("doc_id % 3 <> 0")
    model = kneserney.train(training)
    texts = [(r[0], words(r[1]) + [b"\n"]) for r in corpus]
    c, pairs = Counter(), Counter()
    for i, w in texts:
        if i % 3:
            c.update(w)
            pairs.update(zip([b" ", *w], w))
    follow, before, total = defaultdict(lambda: [0, 0, 0]), Counter(), Counter()
    for (a, b), n in pairs.items():
        follow[a][min(n, 3) - 1] += 1
        before[b] += 1
        total[a] += n

    def cut(counts):
        return [0, *kneserney.discounts(*[sum(x == i for x in counts) for i in (1, 2, 3, 4)])]

    d, e = cut(pairs.values()), cut(before.values())
    floor = sum(e[min(x, 3)] for x in before.values()) / len(pairs) / (len(c) + 1)

    def p(a, b):
        low = max(before[b] - e[min(before[b], 3)], 0) / len(pairs) + floor
        if not total[a]:
            return low
        n = pairs[a, b]
        return (max(n - d[min(n, 3)], 0) + sum(x * y for x, y in zip(d[1:], follow[a])) * low) / total[a]

    assert abs(sum(p(b"the", b) for b in c) + p(b"the", b"?") - 1) < 1e-9
    n_all = sum(c.values())
    want = {i: (len(w), sum(x in c for x in w), n_all,
                sum(math.log10((c[x] + 1) / (n_all + len(c) + 1)) for x in w),
                sum(math.log10(p(a, b)) for a, b in zip([b" ", *w], w))) for i, w in texts}
    for r in kneserney.score(docs, model, F.col("doc_id")).collect():
        assert tuple(r)[1:] == pytest.approx(want[r.doc_id], rel=1e-9)
    assert kneserney.score(none, model, F.col("doc_id")).count() == 0
    blank = kneserney.score(docs, kneserney.train(none), F.col("doc_id")).agg(F.max("n_known")).first()[0]
    assert blank == 0


def test_large_pair_counts_are_kept(docs, monkeypatch):
    monkeypatch.setattr(kneserney, "FULL", 2)
    small = kneserney.train(docs)
    found = {(r.doc_id, r.score) for r in kneserney.score(docs, small, F.col("doc_id")).collect()}
    monkeypatch.setattr(kneserney, "FULL", 65535)
    again = kneserney.train(docs)
    assert {(r.doc_id, r.score) for r in kneserney.score(docs, again, F.col("doc_id")).collect()} == found


def test_languages(spark, none):
    rows = [(i, t and t * n, lang) for i, (t, n, lang) in enumerate([
        ("the cat and the dog of it ", 9, "en"), ("der Hund und die Katze ist ", 9, "de"),
        ("le chien et la souris est ", 9, "fr"), ("the man of the sea ", 2, None), (None, 1, "en"), ("", 1, "de")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = ecoc.train(docs.select("lang", "text"))
    found = {r.doc_id: r for r in ecoc.identify(docs, model, F.col("doc_id")).collect()}
    assert [found[i].lang_pred for i in range(6)] == ["en", "de", "fr", "en", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert ecoc.identify(none, model, F.col("doc_id")).count() == 0
    assert {r.lang_pred for r in ecoc.identify(docs, ecoc.train(none.select("lang", "text")),
                                               F.col("doc_id")).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    labels = docs.select("doc_id", F.lit(0).alias("toxic"), F.lit("x").alias("text"))
    scored = nnpu.score(docs, nnpu.train(docs, labels, F.lit(True)), F.col("doc_id"))
    assert scored.filter("predicted = 1 or score < 0 or score > 1").count() == 0
    assert nnpu.score(none, nnpu.train(none, labels.limit(0), F.lit(True)), F.col("doc_id")).count() == 0


def test_toxicity_of_long_texts(spark):
    """The telling words have the largest hashes of texts with many features."""
    every = [f"w{i}" for i in range(2600)]
    order = sorted(every, key=lambda w: nnpu.features(pa.array([w]))[0].min())
    filler, bad = order[:-5], order[-5:]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.sample(filler, 2500) + (bad if i < 60 else []))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 300, 2)], "doc_id long, toxic int")
    model = nnpu.train(docs, labels, F.lit(True))
    found = nnpu.score(docs, model, F.col("doc_id")).filter("predicted = 1").collect()
    assert {r.doc_id for r in found} == set(range(60))
    assert set(model.keys.tolist()) >= set(nnpu.features(pa.array(bad))[0].tolist())


def test_resampling(spark, none):
    rng = random.Random(2)
    good = [" ".join(rng.choices(["the", "cat,", "sat.", "On", "mat"], k=60)) for _ in range(60)]
    junk = [" ".join(f"{w}%%%" for w in rng.choices(["thnd", "iner", "ther"], k=60)) for _ in range(15)]
    rows = list(enumerate([*good, *junk, None, ""])) + [(3, good[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    found = resampling.resample(docs, labels).collect()
    assert len(found) == len(rows)
    assert {r.doc_id for r in found if not r.kept} == set(range(60, 75))
    assert resampling.resample(none, labels).count() == 0
    assert {r.kept for r in resampling.resample(docs, labels.limit(0)).collect()} == {True}


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice((1.0, 2.0, rng.random() * 1e6)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 500, 1999, 3000):
        for few in (10_000, 5):
            resampling.FEW, old = few, resampling.FEW
            try:
                assert resampling.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
            finally:
                resampling.FEW = old


def test_open_files_do_not_grow_with_the_model(docs, corpus, monkeypatch):
    import os

    monkeypatch.setattr(kneserney, "RANGE_KEYS", 20)  # very many small files
    model = kneserney.train(docs)
    texts = pa.array([r[1] for r in corpus], pa.string())
    assert model.n_ranges > 100
    kneserney._maps.clear()
    want = model.score(texts)
    monkeypatch.setattr(kneserney, "OPEN", 8)
    kneserney._maps.clear()
    before = len(os.listdir("/proc/self/fd"))
    got = model.score(texts)
    assert len(kneserney._maps) <= 8 and len(os.listdir("/proc/self/fd")) <= before + 10
    assert all((got[c] == want[c]).all() for c in want)

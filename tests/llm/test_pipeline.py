"""The pipeline's stages, each held against a plain version on what the stage before kept."""

import re
from collections import defaultdict

import pytest
import tokenizers

import corpus_pipeline
from fiscalarc.llm.queries import tokenizer_path
from fiscalarc.llm.shared import stored, table

SF = "/root/testdata/sf0.001"


def lowered(text):
    return bytes(b + 32 if 65 <= b < 91 else b for b in (text or "").encode())


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before and after every stage, with rows without id or text and a repeated one."""
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (10**6, None, None, None, None),
                                 (10**6 + 1, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.filter("doc_id = 7"))
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stored(stage(spark, out[-1][1], SF), name)))
    return [(name, df.columns, df.collect()) for name, df in out]


def test_stages_keep_the_columns(steps):
    for _, columns, _ in steps[1:-1]:
        assert columns == steps[0][1]
    assert [n for n, _, _ in steps[1:]] == ["quality", "toxicity", "near_copies", "decontaminate", "pack"]


def test_filters_keep_clean_documents(spark, steps):
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    for before, after, mark, bad in ((0, 1, "quality", 0), (1, 2, "toxic", 1)):
        kept = {r.doc_id for r in steps[after][2]}
        assert {None, 10**6, 10**6 + 1} <= kept
        judged = [r.doc_id for r in steps[before][2] if r.doc_id in labels]
        clean = [i for i in judged if labels[i][mark] != bad]
        assert all(i in kept for i in clean)
        assert sum(i not in kept for i in judged) > 0


def test_one_of_each_group_stays(steps):
    sets = {}
    for r in steps[2][2]:
        w = re.findall(rb"[^\x20\x09-\x0D]+", lowered(r.text))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if None not in (a, b) and a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    kept = [r.doc_id for r in steps[3][2]]
    assert sorted(kept, key=str) == sorted({root(i) for i in sets}, key=str)


def test_contaminated_documents_go(spark, steps):
    def words(text):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    windows = {tuple(w[i:i + 10]) for r in table(spark, SF, "benchmark").collect() for w in [words(r.text)]
               for i in range(len(w) - 9)}
    clean = [r.doc_id for r in steps[3][2] for w in [words(r.text)]
             if not any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))]
    assert sorted((r.doc_id for r in steps[4][2]), key=str) == sorted(clean, key=str)
    assert len(clean) < len(steps[3][2])


def test_all_kept_documents_are_packed(steps):
    coder = tokenizers.Tokenizer.from_file(tokenizer_path())
    packed, filled = defaultdict(int), defaultdict(int)
    for r in steps[5][2]:
        packed[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert packed == {r.doc_id: len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1
                      for r in steps[4][2]}
    assert max(filled.values()) <= 1024 and sorted(filled) == list(range(len(filled)))


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "b " * 9, "en", "s", 1, 5, True), (1, "a " * 9, "en", "s", 1, 6, False), (2, "c d e f g h", "en", "s", 1, 7, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "rejected_id long, contaminated boolean")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
    kept = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.rejected_id) for r in kept) == [(1, 6), (2, 7)]

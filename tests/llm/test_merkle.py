"""Merkle manifests against a plain recursive version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fiscalarc.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(map(encoded, (*row[:4], text))))


def proved(hashes, at):
    """The root over ``hashes`` and the siblings of the one at ``at``, level by level."""
    siblings = []
    while len(hashes) > 1:
        run = at // 16 * 16
        siblings += [h for i, h in enumerate(hashes[run:run + 16], run) if i != at]
        hashes = [sha("".join(hashes[i:i + 16])) for i in range(0, len(hashes), 16)]
        at //= 16
    return hashes[0], siblings


def plain(rows, changed):
    key = {r[1]: (r[1] is not None, (r[1] or "").encode()) for r in rows}
    groups = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
              for s in sorted(key, key=key.get)}
    leaves = {s: [leaf(r, r[4]) for r in g] for s, g in groups.items()}
    roots = [proved(h, 0)[0] for h in leaves.values()]
    out = []
    for n, (s, g) in enumerate(groups.items()):
        for i, r in enumerate(g):
            subroot, inside = proved(leaves[s], i)
            root, outside = proved(roots, n)
            text = r[4].translate({c: c + 32 for c in range(65, 91)}) if changed(r[0]) and r[4] else r[4]
            mine = leaves[s][:i] + [leaf(r, text)] + leaves[s][i + 1:]
            top = proved(roots[:n] + [proved(mine, 0)[0]] + roots[n + 1:], 0)[0]
            out.append((r[0], leaves[s][i], subroot, root, sha("".join(inside + outside)), top, top == root))
    return sorted(out, key=str)


def rows(seed, sizes):
    rng = random.Random(seed)
    out = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "lower", "Upper CASE é", "ÄÖ only", "X" * 50])
            out.append((rng.choice([rng.randrange(10**6), -5, None]) if n > 3 else rng.randrange(10**6), source,
                        rng.choice([None, "de"]), rng.choice([None, 0, 17]), text, "t", 3))
    return out + out[:2]


CASES = {
    "hot source, lone leaves, a null source": {"hot": 600, None: 33, "b": 16, "c": 17, "d": 1, "é": 1, "z": 2},
    "one source": {"only": 300},
    "one row a source": {f"s{i}": 1 for i in range(40)},
    "one small source": {"only": 9},
}


@pytest.mark.parametrize("name, lane", [*((n, 4096) for n in CASES), (next(iter(CASES)), 1),
                                        (next(iter(CASES)), 16)])
def test_manifest(spark, monkeypatch, name, lane):
    monkeypatch.setattr(merkle, "LANE", lane)
    data = rows(3, CASES[name])
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA).repartition(4), F.col("doc_id") % 5 == 0)
    want = plain(data, lambda i: i is not None and i % 5 == 0)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == want
    assert any(w[6] for w in want) and (len(want) < 50 or any(not w[6] for w in want))


def test_single_and_no_rows(spark):
    one = [(7, "s", "en", 3, "Abc", "t", 1)]
    got = merkle.manifest(spark.createDataFrame(one, SCHEMA), F.lit(True)).first()
    assert got["root"] == got["leaf"] == leaf(one[0], "Abc")
    assert got["folded_root"] == leaf(one[0], "abc") and not got["verified"] and got["proof_sha256"] == sha("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []

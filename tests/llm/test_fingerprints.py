"""Fingerprints against a plain one-permutation MinHash, and their bias and spread."""

import hashlib
import random
import statistics

import xxhash

from fiscalarc.llm import fingerprints
from fiscalarc.llm.fingerprints import _OFFSET, _STEP, BINS, BITS

SCHEMA = "doc_id long, text string, fingerprint string, before long"


def of_long(x, seed=42):
    return xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)


def of_int(x, seed):
    """The hash of a 32-bit number, which is not that of its four bytes."""
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    m = 2**64
    h = (seed + 0x27D4EB2F165667C5 + 4) % m
    h ^= x * p1 % m
    h = ((h << 23 | h >> 41) % m * p2 + p3) % m
    h = (h ^ h >> 33) * p2 % m
    h = (h ^ h >> 29) * p3 % m
    return h ^ h >> 32


def sets(text):
    words = [w for w in (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ") if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(len(hashed) - 4) if len(hashed) > 4 else range(1 if hashed else 0):
        h = 42
        for x in hashed[i:i + 5]:
            h = of_long(x, h)
        out.add(h)
    return out


def plain(text):
    least = {}
    for h in sets(text):
        signed = h - 2**64 if h >= 2**63 else h
        i = (signed >> 64 - BINS.bit_length() + 1) + BINS // 2
        least[i] = min(least.get(i, signed), signed)
    if not least:
        return ""
    values = [least[i] if i in least else least[min(least, key=lambda j: (j - _OFFSET[i]) * _STEP[i] % BINS)]
              for i in range(BINS)]
    return "".join(f"{of_int(i, of_long(v)) % 2**BITS:0{BITS // 4}x}" for i, v in enumerate(values))


def near(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    d = BITS // 4
    equal = sum(a[i:i + d] == b[i:i + d] for i in range(0, len(a), d))
    return max(0.0, (equal / BINS - 2**-BITS) / (1 - 2**-BITS))


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)] + ["É", "ñandú", "😀"]
    out = [None, "", " \n\t", "one", "One", "é", "a b c d", "a b c d e", "😀" * 10]
    out += [" ".join(rng.choices(vocabulary, k=rng.choice((2, 4, 6, 20, 90, 400, 3000)))) for _ in range(50)]
    return out + [out[20]] * 3


def test_edited_documents(spark):
    rows = [(5 * i - 40 if i != 30 else None, t, "x", 1) for i, t in enumerate(texts())]
    rows.append(rows[12])
    got = fingerprints.edited(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    after = {r[0]: order[(n + 1) % len(order)][1] or "" for n, r in enumerate(order)}
    want = []
    for i, text, *_ in rows:
        text = text or ""
        cut = len(text) // 3
        changed = text[:len(text) - cut] + after[i][:cut]
        a, b, c = plain(text), plain(changed), plain(after[i])
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_odd_tables(spark):
    assert fingerprints.edited(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = fingerprints.edited(spark.createDataFrame([(3, "abcdef", "", 0)], SCHEMA)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    # rows that share an id, or have none, keep a result each
    rows = [(1, "b", "", 0), (1, "a", "", 0), (None, "n m o", "", 0), (None, None, "", 0), (2, "xyz", "", 0)]
    got = fingerprints.edited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "None", "None"]


def test_likeness_has_no_bias(spark):
    rng = random.Random(8)
    rows, true = [], []
    for n in (8, 40, 300):  # few, some and no empty bins
        for same in (0.3, 0.75):
            for _ in range(40):
                both = [f"s{rng.random()}" for _ in range(round(n * same))]
                own = [[f"s{rng.random()}" for _ in range((n - len(both)) // 2)] for _ in range(2)]
                true.append(len(both) / (len(both) + sum(map(len, own))))
                rows.append((len(rows), plain_of(both + own[0]), plain_of(both + own[1]), 0))
    got = [near(r[1], r[2]) for r in rows]
    for n in range(0, len(rows), 40):
        errors = [g - t for g, t in zip(got[n:n + 40], true[n:n + 40])]
        assert abs(statistics.mean(errors)) < 0.06


def plain_of(items):
    """The fingerprint of a set of single-shingle texts."""
    least = {}
    for x in items:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        signed = h - 2**64 if h >= 2**63 else h
        i = (signed >> 64 - BINS.bit_length() + 1) + BINS // 2
        least[i] = min(least.get(i, signed), signed)
    values = [least[i] if i in least else least[min(least, key=lambda j: (j - _OFFSET[i]) * _STEP[i] % BINS)]
              for i in range(BINS)]
    return "".join(f"{of_int(i, of_long(v)) % 2**BITS:0{BITS // 4}x}" for i, v in enumerate(values))

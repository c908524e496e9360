"""Document fingerprints: one-permutation MinHash of word shingles. DataFrame functions only.

Each distinct run of five words (of a shorter text: all of its words) is hashed once. The first bits
of the hash name one of ``BINS`` bins, and each bin keeps its smallest hash. An empty bin takes the
hash of a bin that is not: every bin tries the others in a fixed order of its own, which depends on
the bin alone, so two sets that leave the same bin empty draw from the same place (optimal
densification). Of the hash and the bin's number together, ``BITS`` low-order bits are kept and
written as hexadecimal digits. Unlike bins agree by chance once in 2^BITS, which ``likeness``
takes out of the share of equal bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import windowed
from .divergence import SPACE, let
from .shared import stored

#: a power of two, at most 2^16; and bits per bin, a multiple of four
BINS, BITS = 128, 8
WORDS = 5
_SHIFT = 64 - (BINS.bit_length() - 1)
_DIGITS = BITS // 4
#: the largest hash a bin can hold stands for an empty one; bins are numbered by their first bits, signed
_EMPTY = [((b + 1) << _SHIFT) - 1 for b in range(-BINS // 2, BINS // 2)]


def _mixed(x: int) -> int:
    x = (x * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
    return x ^ x >> 32


#: bin i tries bin j at its turn ((j - offset) * step) mod BINS: an odd step passes every bin once
_STEP = [_mixed(2 * i) % BINS | 1 for i in range(BINS)]
_OFFSET = [_mixed(2 * i + 1) % BINS for i in range(BINS)]


def _table(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def shingles(text: Column) -> Column:
    """Hashes of the text's shingles, repeats included; null and blank texts have none."""
    def grams(hashes: Column) -> Column:
        return F.when(F.size(hashes) >= WORDS, F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WORDS),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WORDS)]))).when(
            F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def bins(hashes: Column) -> Column:
    """The smallest hash per bin; the bin's largest possible one if it is empty."""
    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (
            F.shiftright(F.get(ordered, i - 1), _SHIFT) != F.shiftright(h, _SHIFT)))

    return let(F.sort_array(F.concat(hashes, _table(_EMPTY))), firsts)


def densified(least: Column) -> Column:
    """``bins`` with every empty one filled; at least one must not be."""
    empty, step, offset = _table(_EMPTY), _table(_STEP), _table(_OFFSET)

    def filled(full: Column) -> Column:
        def taken(i: Column) -> Column:
            turns = F.transform(full, lambda j: F.pmod((j - F.get(offset, i)) * F.get(step, i), F.lit(BINS)) * BINS + j)
            return F.get(least, F.array_min(turns) % BINS)

        return F.transform(least, lambda h, i: F.when(h != F.get(empty, i), h).otherwise(taken(i)))

    return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)),
                        lambda i: F.get(least, i) != F.get(empty, i)), filled)


def fingerprint(text: Column) -> Column:
    """``BINS`` packed values as hexadecimal text; a text without words has the empty one."""
    def packed(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda h, i: F.lower(F.substring(
            F.hex(F.xxhash64(h, i).bitwiseAND(F.lit((1 << BITS) - 1)) + (1 << BITS)), 2, _DIGITS))), "")

    return let(shingles(text), lambda s: F.when(F.size(s) == 0, "").otherwise(
        let(bins(s), lambda least: let(densified(least), packed))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts of two fingerprints, 0 to 1.

    Equal fingerprints have 1, an empty one and another 0.
    """
    def part(x: Column, i: Column) -> Column:
        return F.substring(x, i * _DIGITS + 1, F.lit(_DIGITS))

    chance = 2.0**-BITS
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: part(a, i) == part(b, i)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(
        F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and fingerprint; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text")).alias("fingerprint"))


def edited(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document, in descending
    order of ``doc_id``, the first one after the last. Rows without a ``doc_id`` come last and are one
    document in that order, as are rows that share one: their successor is one and the same, and for
    the document before them the text of the smallest hash stands for all. Each row still has a result
    of its own. A document alone is its own successor. Null texts are empty; an empty table gives no
    rows; other columns are not read.

    Only ids and lengths are ordered. Each document then sends its beginning, as much as the one
    before it needs, to that one. Both steps read one shuffle of the texts by id: everything else is
    worked out behind it, so that its columns are the same for both.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("none")).alias("key"),
                        F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    ids = stored(texts.select("key", third.alias("need"), F.xxhash64("text").alias("stands")).groupBy(
        "key").agg(F.max("need").alias("need"), F.min("stands").alias("stands")), "order")
    number = F.expr("try_cast(key AS bigint)")
    # ascending, so that the document before, in descending order, is the next one here
    order = stored(windowed(ids.withColumn("number", number), [], [F.col("number")], before=("lead", "key"),
                            wanted=("lead", "need"), place=("row_number",)), "successors")
    last = order.agg(F.max("place").alias("n"), F.min_by("need", "place").alias("need"),
                     F.min_by("key", "place").alias("key")).first()
    # the largest id follows the smallest one
    end = F.col("place") == last["n"]
    order = order.select("key", "stands", F.when(end, F.lit(last["key"])).otherwise(F.col("before")).alias("before"),
                         F.when(end, F.lit(last["need"])).otherwise(F.col("wanted")).cast("int").alias("wanted"))
    # not an equality, which would become a second key of the join and a shuffle of its own
    stands = F.xxhash64("text").bitwiseXOR(F.col("stands")) == 0
    begins = texts.join(order, "key").filter(stands).select(
        F.col("before").alias("key"), F.substring("text", F.lit(1), F.col("wanted")).alias("begin"),
        fingerprint(F.col("text")).alias("next_fingerprint"))
    begins = begins.groupBy("key").agg(F.first("begin").alias("begin"),
                                       F.first("next_fingerprint").alias("next_fingerprint"))
    both = texts.join(begins, "key").select(
        number.alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        fingerprint(F.col("text")).alias("fingerprint"), "next_fingerprint",
        F.concat(F.substring("text", F.lit(1), F.length("text") - third),
                 F.substring("begin", F.lit(1), third)).alias("edited"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

"""Quality rules from the divergence of a document's histograms from those of its language.

DataFrame functions only. Each text is read once and reduced to counts: the base rules' counts, a
histogram of character classes, and one of the language's common words. The references are the sums
of these histograms over all documents that pass the base rules, per language. A language without a
list of common words has a reference of characters alone. A document fails if
the Jensen-Shannon distance (0 to 1) of one of its histograms from the reference is too large.
Histograms of few characters or words scatter: the limit falls with their size, and each distance
has a minimum length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, stored

#: fixed values: the most common words of each language
COMMON_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "in", "von", "zu", "mit", "den", "nicht", "ein",
           "eine", "auf", "für"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as",
           "with", "be"],
    "es": ["el", "la", "de", "que", "y", "en", "un", "los", "se", "del", "las", "por", "con", "para",
           "una"],
    "fr": ["le", "la", "les", "de", "et", "des", "un", "une", "est", "que", "en", "du", "pour",
           "qui", "dans"],
}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: largest distance: a + b / sqrt(size), as a small histogram scatters; and the least size judged
CHAR_DISTANCE, CHAR_LENGTH = (0.15, 1.5), 100
WORD_DISTANCE, WORD_LENGTH = (0.13, 1.3), 50
WINDOW = 5
SPACE = r"[ \t-\r]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside a ``WINDOW``-word window that the text has twice or more, the first included.

    Windows are compared by 64-bit hash. Equal ones are neighbours after sorting; the union of their
    places is a sum over gaps. A text without an equal pair is done before the sort.
    """
    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.coalesce(
            F.least(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def doubles(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["v"] == x["v"])
                         | (F.get(ordered, i + 1)["v"] == x["v"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(
            *[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(
            let(F.sort_array(F.transform(
                g, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), doubles)))

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def counts(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """Per document: doc_id, language, the base counts, ``chars`` and ``words`` histograms."""
    text = F.coalesce("text", F.lit(""))
    every = sorted({w for words in common.values() for w in words})

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
            .alias("n_dup_lines"),
            F.filter(words, lambda w: w.isin(every)).alias("common"))

    def number(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    first = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"),
        let(F.array_remove(F.split(text, SPACE + "+"), ""), of_words).alias("w"),
        F.length(text).cast("long").alias("length"), number(SPACE).alias("space"),
        number("[A-Z]").alias("upper"), number("[0-9]").alias("digit"),
        number(r"[#*$%&|<>]").alias("n_symbols"), number(r"[.,;:!?'\"()\-]").alias("mark"),
        number(r"[^\x00-\x7F]").alias("beyond"))

    # a generator keeps the steps above and below apart, so each is computed once
    row = first.select("doc_id", "lang", F.explode(F.array(F.struct(
        "w", "length", "space", "upper", "digit", "n_symbols", "mark", "beyond"))).alias("r"))
    def lacking(words: list[str]) -> Column:
        return -F.size(F.filter("r.w.common", lambda w: w.isin(words)))

    hits = F.array_sort(F.array(*[F.struct(lacking(words).alias("n"), F.lit(lang).alias("lang"))
                                  for lang, words in sorted(common.items())]))
    language = F.coalesce("lang", hits[0]["lang"])
    mine = F.create_map(*[x for lang, words in sorted(common.items())
                          for x in (F.lit(lang), F.array(*map(F.lit, words)))])
    none = F.array().cast("array<string>")
    word_counts = let(language, lambda lang: let(F.coalesce(F.try_element_at(mine, lang), none), lambda words: F.transform(
        words, lambda c: F.size(F.filter("r.w.common", lambda w: w == c)).cast("long"))))
    rest = F.greatest(F.lit(0).cast("long"), F.col("r.length") - F.col("r.space") - F.col("r.upper")
                      - F.col("r.digit") - F.col("r.n_symbols") - F.col("r.mark") - F.col("r.beyond"))
    wide = row.select(
        "doc_id", language.alias("language"), "r.w.n_words",
        (F.col("r.length") - F.col("r.space")).alias("word_chars"), "r.n_symbols",
        "r.w.n_dup_lines", "r.w.n_repeat_words",
        F.array("r.space", "r.upper", "r.digit", "r.n_symbols", "r.mark", "r.beyond", rest)
        .alias("chars"), word_counts.alias("hit"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    others = F.col("n_words") - F.aggregate("hit", F.lit(0).cast("long"), lambda a, b: a + b)
    return wide.select(
        "doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), "chars", F.concat("hit", F.array(others)).alias("words"))


def distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms; 0 if one of them is empty."""
    def share(h: str) -> Column:
        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, b: a + b)
        return let(total, lambda n: F.transform(h, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    parts = let(share(own), lambda p: let(share(reference), lambda q: F.aggregate(
        F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2)),
        F.lit(0.0), lambda a, b: a + b)))
    empty = (F.array_max(own) == 0) | F.col(reference).isNull() | (F.array_max(reference) == 0)
    return F.when(empty, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), parts / 2)))


def quality(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, kept, language, both distances.

    Null text has no words, so it fails the base rules. A null ``lang`` takes the language of
    ``common`` whose words the text has most; the words of a ``lang`` that is not in ``common`` are not
    judged. Rows that share a ``doc_id`` are judged each on
    its own; an empty table gives no rows; other columns are not read. Without a document that
    passes the base rules a language has no reference and no distance rejects.
    """
    found = stored(counts(docs, common), "quality-counts")
    # one row per language
    reference = found.filter(~F.col("base_failed")).select(
        "language", F.posexplode(F.concat("chars", "words")).alias("pos", "n")) \
        .groupBy("language", "pos").agg(F.sum("n").alias("n")) \
        .groupBy("language").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("all")) \
        .select("language", F.transform("all", lambda x: x["n"]).alias("all")) \
        .select("language", F.slice("all", 1, 7).alias("ref_chars"),
                F.slice("all", 8, 1000).alias("ref_words"))
    far = found.join(lookup(stored(reference, "references")), "language", "left").select(
        "*", distance("chars", "ref_chars").alias("char_distance"),
        distance("words", "ref_words").alias("word_distance"))

    def too_far(distance: str, size: str, limit: tuple[float, float], least: int) -> Column:
        return (F.col(size) >= least) & (
            F.col(distance) > limit[0] + limit[1] / F.sqrt(F.col(size)))

    strange = too_far("char_distance", "word_chars", CHAR_DISTANCE, CHAR_LENGTH) | too_far(
        "word_distance", "n_words", WORD_DISTANCE, WORD_LENGTH)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), "language",
                      F.round("char_distance", 6).alias("char_distance"),
                      F.round("word_distance", 6).alias("word_distance"))

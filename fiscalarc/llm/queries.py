"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    divergence,
    ecoc,
    fingerprints,
    fmindex,
    jaccard,
    kneserney,
    merkle,
    nnpu,
    packing,
    resampling,
    simple8b,
    tagpaths,
)
from .shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, window=1024)


@_query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, files = simple8b.write_ids(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return simple8b.read_ids(spark, uri, files)


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fmindex.contamination(docs, benchmark, window=10).drop("spans")


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.quality(table(spark, sf_dir, "documents"))


@_query
def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(table(spark, sf_dir, "pages"))


def remainder(n: int) -> Column:
    """crc32 of the document's id as text, modulo ``n``: the folds of the held-out queries."""
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % n


@_query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    model = ecoc.train(docs.filter(remainder(3) != 1).select("lang", "text"))
    return ecoc.identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"),
                         held_out.alias("held_out"))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nnpu.train(docs, labels, remainder(5) != 0)
    return nnpu.score(docs, model, F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))


@_query
def op4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard.join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query
def op7_word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = kneserney.train(docs.filter(remainder(7) != 2))
    return kneserney.score(docs, model, F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"))


@_query
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


@_query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), remainder(5) == 0).drop("source")


@_query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path(),
                               public_tokenizers.path("piece_bpe_32k.model"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE["op2_near_copies"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
    ELSE [] END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, CAST(min(len(s)) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY 1"""

ORACLE["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ')
    AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p))),
h AS (SELECT doc_id, i, k, item_id FROM x JOIN p USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(k)) AS j FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)"""


def _distance_sql(own: str, a: str, b: str) -> str:
    def half(x: str) -> str:
        return f"CASE WHEN {x}[i] > 0 THEN {x}[i] * log2({x}[i] / (({a}[i] + {b}[i]) / 2)) ELSE 0 END"

    return f"""CASE WHEN list_max({own}) = 0 OR {b} IS NULL THEN 0.0 ELSE sqrt(greatest(0.0, list_sum(
    list_transform(range(1, len({a}) + 1), lambda i: {half(a)}
      + {half(b)})) / 2)) END"""


def _divergence_sql() -> str:
    lists = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in sorted(divergence.COMMON_WORDS.items()))
    return f"""
WITH c(language, common) AS (VALUES {lists}),
a AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a)),
z AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(5)) AS j FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, arg_max(language, (len(list_filter(w, lambda x: list_contains(common, x))),
    -ascii(language), -ascii(language[2:]))) AS language FROM a, c GROUP BY 1),
l AS (SELECT a.*, m.language, coalesce(common, []) AS common, list_filter(string_split(t, chr(10)),
    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(z.n, 0) AS n_repeat_words
  FROM a JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
    LEFT JOIN c ON c.language = coalesce(lang, m.language)),
f AS (SELECT doc_id, coalesce(lang, language) AS language,
  CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
  len(w) < 10 OR 100 * n_repeat_words > 20 * len(w) AS base_failed,
  length(t) AS size, length(t) - length(array_to_string(w, '')) AS space,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
  length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
  length(t) - length(regexp_replace(t, '[.,;:!?''"()\\-]', '', 'g')) AS mark,
  length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS beyond,
  list_transform(common, lambda x: len(list_filter(w, lambda y: y = x))) AS hit FROM l),
h AS (SELECT *, [space, upper, digit, n_symbols, mark, beyond, greatest(0, size - space - upper - digit
    - n_symbols - mark - beyond)] AS chars, list_append(hit, n_words - coalesce(list_sum(hit), 0)) AS words FROM f),
e AS (SELECT language, kind, pos, sum(n) AS n FROM (
    SELECT language, 0 AS kind, generate_subscripts(chars, 1) AS pos, unnest(chars) AS n FROM h
      WHERE NOT base_failed
    UNION ALL SELECT language, 1, generate_subscripts(words, 1), unnest(words) FROM h WHERE NOT base_failed)
  GROUP BY ALL),
r AS (SELECT language, list(n ORDER BY pos) FILTER (kind = 0) AS ref_chars,
    list(n ORDER BY pos) FILTER (kind = 1) AS ref_words FROM e GROUP BY 1),
s AS (SELECT h.*, list_transform(chars, lambda x: x / greatest(1, list_sum(chars))) AS p,
    list_transform(ref_chars, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(ref_chars) AS DOUBLE)) AS q,
    list_transform(words, lambda x: x / greatest(1, list_sum(words))) AS u,
    list_transform(ref_words, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(ref_words) AS DOUBLE)) AS v
  FROM h LEFT JOIN r USING (language)),
d AS (SELECT *, {_distance_sql("chars", "p", "q")} AS cd, {_distance_sql("words", "u", "v")} AS wd FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= 100 AND cd > 0.15 + 1.5 / sqrt(word_chars))
    AND NOT (n_words >= 50 AND wd > 0.13 + 1.3 / sqrt(n_words)) AS kept, language,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM d"""


ORACLE["op8_quality_rules"] = _divergence_sql()


def _encoded_sql(field: str) -> str:
    return f"""CASE WHEN {field} IS NULL THEN '-' ELSE CAST(strlen(CAST({field} AS VARCHAR)) AS VARCHAR)
    || ':' || CAST({field} AS VARCHAR) END"""


def _merkle_sql() -> str:
    fields = " || ".join(_encoded_sql(f) for f in merkle.FIELDS)
    lowered = fields.replace("CAST(text AS VARCHAR)", f"translate(text, {_LOWER})")
    # crc32 bit by bit: eight steps for each character of the decimal id
    crc = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1,
    CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""

    def grown(name: str, key: str) -> str:
        return f"""SELECT {key}, max(level) + 1, place // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM (
    SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}) WHERE n > 1 GROUP BY {key}, place // 16"""

    def folded(name: str, nodes: str, key: str) -> str:
        mine = f"{name}.place // CAST(pow(16, {name}.level) AS BIGINT)"
        return f"""SELECT {name}.id, {name}.k, {name}.place, {name}.level + 1, sha256(string_agg(
      CASE WHEN s.place = {mine} THEN {name}.h ELSE s.hash END, '' ORDER BY s.place)),
    proof || coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place <> {mine}), '')
  FROM {name} JOIN {nodes} s ON s.{key} = {name}.k AND s.level = {name}.level
    AND s.place // 16 = ({mine}) // 16
  JOIN (SELECT {key} AS k, max(level) AS top FROM {nodes} GROUP BY 1) t ON t.k = {name}.k
    AND {name}.level < t.top
  GROUP BY {name}.id, {name}.k, {name}.place, {name}.level, {name}.proof"""

    return f"""
WITH RECURSIVE e AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree,
    sha256({fields}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({lowered}) ELSE sha256({fields}) END AS own
  FROM documents),
p AS (SELECT *, row_number() OVER () AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM e),
lv(tree, level, place, hash) AS (SELECT tree, 0, place, leaf FROM p UNION ALL {grown("lv", "tree")}),
sub AS (SELECT tree, arg_max(hash, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS upper
  FROM lv GROUP BY tree),
up(one, level, place, hash) AS (SELECT 1, 0, upper, subroot FROM sub UNION ALL {grown("up", "one")}),
f(id, k, place, level, h, proof) AS (SELECT id, tree, place, 0, own, '' FROM p UNION ALL {folded("f", "lv", "tree")}),
g(id, k, place, level, h, proof) AS (SELECT id, 1, upper, 0, arg_max(h, level), arg_max(proof, level)
  FROM f JOIN sub ON sub.tree = f.k GROUP BY id, upper UNION ALL {folded("g", "up", "one")}),
z AS (SELECT id, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM g GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub USING (tree) JOIN z USING (id), (SELECT arg_max(hash, level) AS root FROM up)"""


ORACLE["op12_merkle"] = _merkle_sql()

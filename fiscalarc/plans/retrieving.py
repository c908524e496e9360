"""Queries of documents and retrieval. The queries searched for are the ``benchmark`` texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as Q
from ..operators.aggregates import retrieval_metrics
from ..operators.content import SENSITIVE
from ..session import work_dir
from .registry import VIEWS, query

SIZE = 600


def questions(t):
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")


VIEWS["x_passage"] = f"""
  SELECT doc_id, sec, win, min(off) AS s, max(fin) AS e, string_agg(line, chr(10) ORDER BY i) AS text,
    row_number() OVER (PARTITION BY doc_id ORDER BY min(off)) - 1 AS no
  FROM (SELECT doc_id, line, i, off, off + length(line) AS fin,
      last_value(CASE WHEN i > 1 AND contains(line, '|') THEN NULL ELSE off // {SIZE} END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY i) AS win,
      sum(CAST(regexp_matches(lower(line), '{Q.HEADING}') AND NOT (i > 1 AND contains(line, '|')) AS INT))
        OVER (PARTITION BY doc_id ORDER BY i) AS sec
    FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN
        UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)))
  GROUP BY doc_id, sec, win"""


def passages(t):
    return Q.chunk_documents(t.document.select("doc_id", "lang", "source", "text"), "doc_id", "text",
                             SIZE)


query("chunk_documents", """
SELECT doc_id, CAST(no AS INT) AS passage_no, CAST(sec AS INT) AS section, CAST(s AS INT) AS start,
  CAST(e AS INT) AS "end", md5(text) AS text_hash FROM x_passage""")(
    lambda t: passages(t).select("doc_id", "passage_no", "section", "start", "end",
                                 F.md5("text").alias("text_hash")))

query("citation_anchors", """
SELECT doc_id AS document_id, CAST(s // 3000 + 1 AS INT) AS page, CAST(sec AS INT) AS section,
  CAST(s AS INT) AS start, CAST(e AS INT) AS "end", doc_id || '#' || no AS passage_id FROM x_passage""")(
    lambda t: Q.citation_anchors(passages(t), "doc_id").select(
        "passage_id", "anchor.document_id", "anchor.page", "anchor.section",
        "anchor.position.start", "anchor.position.end"))

# Field patterns with their confidence.
FIELDS = {"contact": (SENSITIVE["RESTRICTED"], 0.9),
          "address": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.8),
          "phone": (r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.7)}

query("extract_fields", " UNION ALL ".join(f"""
SELECT doc_id, '{n}' AS field, unnest(regexp_extract_all(text, '{p}')) AS value,
  CAST({c} AS DOUBLE) AS confidence FROM documents""" for n, (p, c) in FIELDS.items()))(
    lambda t: Q.extract_fields(t.document, "doc_id", "text", FIELDS))

_NF = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"

query("search_exact", f"""
WITH d AS (SELECT doc_id, {_NF.format('text')} AS d FROM documents),
q AS (SELECT item_id AS query_id, {_NF.format('text')} AS q FROM benchmark)
SELECT query_id, doc_id FROM d JOIN q ON contains(d, q)""")(
    lambda t: Q.search_exact(t.document, questions(t)))

VIEWS["x_tok"] = """SELECT doc_id, lang, len(words) AS dl, unnest(words) AS token FROM x_words
  JOIN documents USING (doc_id)"""
VIEWS["x_tf"] = "SELECT doc_id, lang, dl, token, count(*) AS tf FROM x_tok GROUP BY ALL"
VIEWS["x_q"] = """SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id,
  unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark) GROUP BY ALL"""


def _bm25(where):
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id
      ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT query_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM x_tf t JOIN x_q USING (token)
    JOIN (SELECT token, count(*) AS df FROM x_tf WHERE {where} GROUP BY 1) USING (token),
    (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(words)) AS avgdl FROM x_words JOIN documents
      USING (doc_id) WHERE {where}) s
    WHERE {where} GROUP BY query_id, t.doc_id)"""


VIEWS["x_lex"] = f"SELECT * FROM ({_bm25('TRUE')}) WHERE rank <= 20"
VIEWS["x_sparse"] = """SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  WITH df AS (SELECT token, count(*) AS df FROM x_tf GROUP BY 1),
  nn AS (SELECT doc_id, sqrt(sum(pow(1 + ln(tf), 2))) AS norm FROM x_tf GROUP BY 1),
  qw AS (SELECT query_id, token, (1 + ln(qtf)) * ln((SELECT count(*) FROM documents) / CAST(df AS DOUBLE))
    AS w FROM x_q JOIN df USING (token)),
  qn AS (SELECT query_id, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY 1)
  SELECT query_id, doc_id, round(sum((1 + ln(tf)) * w / (norm * qnorm)), 6) AS score
  FROM x_tf JOIN qw USING (token) JOIN nn USING (doc_id) JOIN qn USING (query_id)
  WHERE qnorm > 0 GROUP BY ALL)) WHERE rank <= 20"""
VIEWS["x_fused"] = """SELECT query_id, doc_id, score, n_lists, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0 / (rank + 60)), 8)
    AS score, count(*) AS n_lists FROM (SELECT query_id, doc_id, rank FROM x_lex
      UNION ALL SELECT query_id, doc_id, rank FROM x_sparse) GROUP BY ALL)
  QUALIFY rank <= 10"""

query("search_lexical", "SELECT query_id, doc_id, score, rank FROM x_lex")(
    lambda t: Q.search_lexical(t.document, questions(t), 20).select("query_id", "doc_id", "score",
                                                                   "rank"))
query("search_sparse", "SELECT query_id, doc_id, score, rank FROM x_sparse")(
    lambda t: Q.search_sparse(t.document, questions(t), 20).select("query_id", "doc_id", "score",
                                                                  "rank"))

query("search_dense", """
WITH d AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings),
c AS (SELECT label AS query_id, i, avg(x) AS m FROM d GROUP BY ALL),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings),
s AS (SELECT query_id, vec_id, round(sum(x * m), 6) AS score FROM v JOIN c USING (i) GROUP BY ALL)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")(
    lambda t: Q.search_dense(t.raw("embeddings"), Q.centroids(t.raw("embeddings"), "label"), 10)
    .select("query_id", "vec_id", "score", "rank"))



@query("search_indexed")
def _(t):
    """Every twentieth vector against all, through the index; tests measure its recall."""
    vectors, path = t.raw("embeddings"), work_dir(t.spark, "vectors")
    Q.build_vector_index(vectors, path)
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"),
                                                      F.col("embedding").alias("vector"))
    return Q.search_vector_index(t.spark, path, queries, 10)


query("search_filtered", f"""
SELECT query_id, doc_id, score, rank FROM ({_bm25("lang = 'en'")}) WHERE rank <= 10""")(
    lambda t: Q.search_filtered(t.document, questions(t), F.col("lang") == "en", 10).select(
        "query_id", "doc_id", "score", "rank"))


def fused(t):
    q = questions(t)
    index = Q.corpus_index(t.document, q)  # one for both searches
    return Q.fuse_rankings([Q.search_lexical(t.document, q, 20, index=index),
                            Q.search_sparse(t.document, q, 20, index=index)], 10)


query("fuse_rankings", "SELECT query_id, doc_id, score, n_lists, rank FROM x_fused")(fused)


@query("rerank", """
SELECT query_id, doc_id, first_rank, score2, row_number() OVER (PARTITION BY query_id
  ORDER BY score2 DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, f.rank AS first_rank, round(1.0 / f.rank
    + CAST(coalesce(quality, 0) AS DOUBLE) * 0.25 + CAST(n_chars >= 500 AS INT) * 0.125, 8) AS score2
  FROM x_fused f JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))""")
def _(t):
    features = t.document.select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("long")).join(
        t.raw("labels").select("doc_id", F.col("quality").alias("official")), "doc_id", "left")
    return Q.rerank(fused(t), features, {"official": 0.25, "long": 0.125}).select(
        "query_id", "doc_id", "first_rank", "score2", "rank")


VIEWS["x_dedge"] = """SELECT doc_id AS src, first AS dst FROM (SELECT doc_id, min(doc_id) OVER
    (PARTITION BY source) AS first FROM documents) WHERE doc_id <> first
  UNION SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang) AS first
    FROM documents) WHERE doc_id <> first"""


def document_edges(t):
    """Each document points to the first of its source and the first of its language."""
    docs = t.document.select("doc_id", "source", "lang")
    def first(by):
        lead = docs.groupBy(by).agg(F.min("doc_id").alias("dst"))
        return docs.join(lead, by).filter("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")
    return first("source").unionByName(first("lang")).distinct()


query("graph_expand", """
WITH h AS (SELECT DISTINCT query_id, doc_id FROM x_fused),
o AS (SELECT DISTINCT query_id, dst AS doc_id FROM h JOIN x_dedge ON src = doc_id),
w AS (SELECT DISTINCT query_id, dst AS doc_id FROM o JOIN x_dedge ON src = doc_id)
SELECT query_id, doc_id, CAST(min(hops) AS INT) AS hops FROM (SELECT *, 0 AS hops FROM h UNION ALL
  SELECT *, 1 FROM o UNION ALL SELECT *, 2 FROM w) GROUP BY ALL""")(
    lambda t: Q.graph_expand(fused(t), document_edges(t), 2))

query("near_duplicates", """
WITH s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(
    range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
  ELSE [array_to_string(words, ' ')] END AS s FROM x_words),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id, b.doc_id AS lead, CAST(count(*) AS DOUBLE) AS c, min(a.n) + min(b.n) AS n
  FROM t a JOIN t b ON a.g = b.g AND b.doc_id < a.doc_id GROUP BY 1, 2)
SELECT doc_id, min(lead) AS doc_id_leader, round(arg_min(c / (n - c), lead), 6) AS jaccard
FROM p WHERE c / (n - c) >= 0.7 GROUP BY 1""")(
    lambda t: Q.near_duplicates(t.document, "doc_id", "text"))

VIEWS["x_set"] = "SELECT doc_id, list_distinct(words) AS s FROM x_words"

query("similar_activities", """
WITH q AS (SELECT item_id AS new_id, text AS qt, list_distinct(regexp_extract_all(lower(text),
    '[\\p{L}\\p{N}]+')) AS s FROM benchmark),
p AS (SELECT new_id, doc_id AS past_id, CAST(len(list_intersect(q.s, d.s)) AS DOUBLE)
    / (len(q.s) + len(d.s) - len(list_intersect(q.s, d.s))) AS jaccard,
    CAST(split_part(qt, chr(10), 1) = split_part(text, chr(10), 1) AS INT) AS f,
    CAST(contains(text, qt) AS INT) AS c
  FROM q, x_set d JOIN documents USING (doc_id)),
r AS (SELECT *, round(0.8 * jaccard + 0.1 * f + 0.1 * c, 6) AS score FROM p WHERE jaccard >= 0.15)
SELECT new_id, past_id, jaccard, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY new_id
  ORDER BY score DESC, past_id) AS rank FROM r) WHERE rank <= 5""")(
    lambda t: Q.similar_activities(
        t.raw("benchmark").select(F.col("item_id").alias("new_id"), "text"),
        t.document.select(F.col("doc_id").alias("past_id"), "text"), 0.15, 5).select(
        "new_id", "past_id", "jaccard", "score", "rank"))


def _new_and_past(t):
    au = t.activity_unit.select("activity_id", "program", "execution_mode", "priority", "status",
                                "fiscal_year")
    return au.filter("status = 'IN_PREPARATION'").drop("status", "fiscal_year"), au.filter(
        "status = 'CLOSED'")


@query("suggest_tasks", """
WITH t AS (SELECT program, execution_mode, activity_id, resource_type AS task, min(seq) AS seq
  FROM x_lu JOIN x_price USING (resource_id) WHERE status = 'CLOSED' GROUP BY ALL),
n AS (SELECT program, execution_mode, count(*) AS n FROM x_au WHERE status = 'CLOSED' GROUP BY ALL),
f AS (SELECT program, execution_mode, task, count(*) AS n_examples, min(activity_id) AS example,
  quantile_cont(seq, 0.5) AS sequence FROM t GROUP BY ALL)
SELECT a.activity_id, task, sequence, example, n_examples,
  CAST(n_examples AS DOUBLE) / n AS confidence FROM x_au a
JOIN f USING (program, execution_mode) JOIN n USING (program, execution_mode)
WHERE status = 'IN_PREPARATION' AND CAST(n_examples AS DOUBLE) / n >= 0.4""")
def _(t):
    new, past = _new_and_past(t)
    tasks = t.line.join(t.price.select("resource_id", "resource_type"), "resource_id").select(
        "activity_id", "seq", F.col("resource_type").alias("task"))
    return Q.suggest_tasks(new, past, tasks, ["program", "execution_mode"], 0.4).select(
        "activity_id", "task", "sequence", "example", "n_examples", "confidence")


@query("suggest_resources", """
WITH u AS (SELECT program, execution_mode, label, quantity FROM x_lu JOIN x_price USING (resource_id)
  WHERE status = 'CLOSED'),
f AS (SELECT program, execution_mode, label, count(*) AS n_uses, quantile_cont(quantity, 0.5) AS quantity
  FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY program, execution_mode ORDER BY n_uses DESC, label)
  AS rank FROM f)
SELECT activity_id, label, n_uses, r.quantity, rank FROM x_au JOIN r USING (program, execution_mode)
WHERE status = 'IN_PREPARATION' AND rank <= 5""")
def _(t):
    new, past = _new_and_past(t)
    lines = t.line.join(t.price.select("resource_id", "label"), "resource_id").select(
        "activity_id", "label", "quantity")
    return Q.suggest_resources(new, past, lines, ["program", "execution_mode"], 5).select(
        "activity_id", "label", "n_uses", "quantity", "rank")


VIEWS["x_vote"] = """SELECT label, category, votes, CAST(votes AS DOUBLE) / sum(votes) OVER
    (PARTITION BY label) AS share FROM (SELECT label, category, count(*) AS votes FROM x_line
      JOIN x_price USING (resource_id) JOIN x_category_map USING (resource_type)
      WHERE line_status = 'F' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY votes DESC, category) = 1"""


def _labelled(t, condition):
    return t.line.filter(condition).join(
        t.price.select("resource_id", "label", "resource_type"), "resource_id")


@query("suggest_imputation", """
SELECT activity_id, seq, l.resource_id, v.category, v.votes, v.share, r.allowed IS NOT NULL AS rule_ok
FROM x_line l JOIN x_price p ON l.resource_id = p.resource_id LEFT JOIN x_vote v ON v.label = p.label
LEFT JOIN x_imputation_rule r ON r.resource_type = p.resource_type AND r.allowed = v.category
WHERE line_status = 'O'""")
def _(t):
    history = _labelled(t, "line_status = 'F'").join(t.rule("category_map"), "resource_type")
    return Q.suggest_imputation(_labelled(t, "line_status = 'O'"), history,
                                t.rule("imputation_rule")).select(
        "activity_id", "seq", "resource_id", "category", "votes", "share", "rule_ok")


@query("classify_need", """
WITH k AS (SELECT label, arg_min(category, keyword) AS c, min(keyword) AS w FROM (
    SELECT DISTINCT label, unnest(regexp_extract_all(lower(label), '[\\p{L}\\p{N}]+')) AS keyword
    FROM x_price) JOIN x_keyword_category USING (keyword)
  WHERE category <> 'OTHER' GROUP BY label)
SELECT n.activity_id, n.seq, n.resource_id, coalesce(k.c, v.category) AS proposed,
  CASE WHEN k.c IS NOT NULL THEN 'keyword ' || w ELSE 'vote' END AS evidence
FROM x_need n LEFT JOIN k USING (label) LEFT JOIN x_vote v USING (label)""")
def _(t):
    history = _labelled(t, "line_status = 'F'").join(t.rule("category_map"), "resource_type")
    return Q.classify_need(t.need.drop("category"), history,
                           t.rule("keyword_category").filter("category <> 'OTHER'")).select(
        "activity_id", "seq", "resource_id", "proposed", "evidence")


# Fixed value: keyword of each program.
KEYWORDS = {"AUTOMOBILE": "gear", "BUILDING": "rod", "FURNITURE": "plate", "HOUSEHOLD": "ring",
            "MACHINERY": "bolt"}
WEIGHTS = {"link": 0.4, "keywords": 0.2, "results": 0.2, "indicators": 0.1, "history": 0.1}


@query("alignment_score", f"""
WITH k AS (SELECT activity_id, bool_or(contains(label, CASE program {' '.join(
    f"WHEN '{p}' THEN '{w}'" for p, w in KEYWORDS.items())} END)) AS kw,
  CAST(count(*) FILTER (line_status = 'F') AS DOUBLE) / count(*) AS results
  FROM x_lu JOIN x_price USING (resource_id) GROUP BY 1),
y AS (SELECT DISTINCT budget_activity_id, fiscal_year + 1 AS fiscal_year FROM x_act)
SELECT a.activity_id, round(0.4 * CAST(a.activity_id % 4 <> 0 AS INT) + 0.2 * CAST(coalesce(kw, FALSE) AS INT)
  + 0.2 * coalesce(results, 0.0) + 0.1 * CAST(program IN (SELECT program FROM x_indicator) AS INT)
  + 0.1 * CAST(y.fiscal_year IS NOT NULL AS INT), 6) AS score
FROM x_au a LEFT JOIN k USING (activity_id)
LEFT JOIN y ON y.budget_activity_id = a.budget_activity_id AND y.fiscal_year = a.fiscal_year""")
def _(t):
    words = F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv])
    au = t.activity_unit.select("activity_id", "budget_activity_id", "fiscal_year", "program")
    lines = t.line.join(t.price.select("resource_id", "label"), "resource_id").join(
        au.select("activity_id", "program"), "activity_id")
    per = lines.groupBy("activity_id").agg(
        F.bool_or(F.contains("label", words[F.col("program")])).alias("keywords"),
        (F.count_if(F.col("line_status") == "F").cast("double") / F.count(F.lit(1))).alias("results"))
    before = au.select("budget_activity_id", (F.col("fiscal_year") + 1).alias("fiscal_year"),
                       F.lit(1).alias("history")).distinct()
    has = t.rule("indicator").select("program", F.lit(1).alias("indicators")).distinct()
    features = (au.join(per, "activity_id", "left")
                .join(before, ["budget_activity_id", "fiscal_year"], "left")
                .join(F.broadcast(has), "program", "left")
                .withColumn("link", (F.col("activity_id") % 4 != 0).cast("int"))
                .withColumn("keywords", F.col("keywords").cast("int")))
    return Q.alignment_score(features, WEIGHTS).select("activity_id", "score")


@query("unsupported_claims", """
WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS t,
    generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id || ':' || turn || ':' || i AS claim_id,
    list_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) AS w FROM s),
k AS (SELECT md5(array_to_string(list_sort(w), ' ')) AS h, any_value(w) AS w FROM c WHERE len(w) > 0
  GROUP BY 1),
kt AS (SELECT h, len(w) AS n, unnest(w) AS token FROM k),
ok AS (SELECT DISTINCT h FROM (SELECT h, n, doc_id, count(*) AS m FROM kt
  JOIN (SELECT doc_id, unnest(s) AS token FROM x_set) USING (token) GROUP BY ALL) WHERE m >= ceil(n * 0.7))
SELECT claim_id FROM c WHERE len(w) > 0
  AND md5(array_to_string(list_sort(w), ' ')) NOT IN (SELECT h FROM ok)""")
def _(t):
    claims = t.raw("conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.posexplode(F.split("text", r"\.")).alias("i", "text")).select(
        F.concat_ws(":", "conv_id", "turn", F.col("i") + 1).alias("claim_id"), "text")
    return Q.unsupported_claims(claims, t.document, 0.7)


# the measure of the searches reads their result; it belongs to the aggregates
@query("retrieval_metrics", """
WITH rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d
  ON contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
g AS (SELECT query_id, count(*) AS n_found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg
  FROM x_lex JOIN rel USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, n_relevant, coalesce(n_found, 0) AS n_found,
  CAST(coalesce(n_found, 0) AS DOUBLE) / n_relevant AS recall, coalesce(n_found, 0) / 10.0 AS precision,
  coalesce(1.0 / first, 0.0) AS mrr, round(coalesce(dcg, 0.0) / list_sum(list_transform(
    range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg
FROM n LEFT JOIN g USING (query_id)""")
def _(t):
    hits = Q.search_lexical(t.document, questions(t), 20)
    relevant = Q.search_exact(t.document, questions(t)).select("query_id", "doc_id")
    return retrieval_metrics(hits, relevant, 10)

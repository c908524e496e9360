"""Checks and tags over texts, payloads and actions; row-local expressions plus rule joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import severity, tokens
from ..scale import small

# Patterns of sensitive content, strongest class last.
SENSITIVE = {
    "RESTRICTED": r"[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z0-9.]+",
    "CONFIDENTIAL": r"\d{3}[ .-]\d{2,4}[ .-]\d{3,4}",
    "CRITICAL": r"(token|password|secret|api[_-]?key) *[=:] *\S+",
}
CLASS_LEVEL = {"PUBLIC": 0, "RESTRICTED": 2, "CONFIDENTIAL": 3, "CRITICAL": 4}

# Multi-word instruction patterns looked for in external content.
INSTRUCTIONS = [r"ignore (all )?(previous|prior) instructions", r"token *= *\S+",
                r"you are now .{1,40}assistant", r"permission is hereby granted",
                r"(licensed|released) under the"]


def array_fields(items: DataFrame, keys: list[str], page: int = 1000) -> DataFrame:
    """Build and read list columns: distinct need ids and funding sources per plan item."""
    from .aggregates import need_members
    needs = need_members(items, keys, "need_id", page).withColumnRenamed("members", "source_needs")
    # funding sources are an enumeration, so this set is bounded
    funds = items.groupBy(*keys).agg(
        F.array_sort(F.collect_set("funding_source")).alias("funding_sources"))
    return needs.join(funds, keys).withColumn("n_needs", F.size("source_needs")).withColumn(
        "uses_loan", F.array_contains("funding_sources", "Loan")).withColumn(
        "first_need", F.element_at("source_needs", 1))


def map_fields(obs: DataFrame, keys: list[str], **fields: Column) -> DataFrame:
    """Build a disaggregation map and read it back as entries."""
    made = obs.withColumn("disaggregation", F.create_map(*[
        x for name, c in fields.items() for x in (F.lit(name), c.cast("string"))]))
    return made.select(*keys, F.explode(F.map_entries("disaggregation")).alias("e")).select(
        *keys, F.col("e.key").alias("dimension"), F.col("e.value").alias("member"))


def parse_payload(column: Column | str, schema: str) -> Column:
    """Typed struct from a JSON payload; unreadable fields are null."""
    return F.from_json(column, schema)


def validate_proposals(proposals: DataFrame, grants: DataFrame, rules: DataFrame, limit: str
                       ) -> DataFrame:
    """Schema → permission → rules → approval per proposed command, with verdict and reasons."""
    cmd = F.from_json("payload", "action string, amount decimal(18,2), tool int")
    read = proposals.withColumn("c", cmd).select(
        "proposal_id", "tenant", F.col("c.action").alias("action"), F.col("c.amount").alias("amount"),
        F.col("c.tool").alias("tool"))
    j = (read.join(grants.withColumn("_granted", F.lit(True)), ["tenant", "tool"], "left")
         .join(small(rules), F.col("action") == F.col("kind"), "left"))
    bad_schema = F.col("action").isNull() | F.col("amount").isNull() | F.col("tool").isNull()
    unknown = ~bad_schema & F.col("risk_class").isNull()
    denied = ~bad_schema & F.col("_granted").isNull()
    too_high = ~bad_schema & (F.col("amount") > F.lit(limit).cast("decimal(18,2)"))
    reasons = F.array_compact(F.array(
        F.when(bad_schema, "schema"), F.when(unknown, "unknown action"),
        F.when(denied, "permission"), F.when(too_high, "amount over limit")))
    verdict = (F.when(F.size(reasons) > 0, "REJECTED")
               .when(F.col("approver").isNotNull(), "NEEDS_APPROVAL").otherwise("ACCEPTED"))
    return j.select("proposal_id", "action", verdict.alias("verdict"),
                    F.array_join(reasons, ",").alias("reasons"), F.when(
                        verdict == "NEEDS_APPROVAL", F.col("approver")).alias("approver"))


def action_risk(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Risk class R0–R4 and approver; an unknown action counts as critical."""
    j = actions.join(small(rules), "kind", "left")
    return j.withColumn("risk_class", F.coalesce("risk_class", F.lit("R4"))).withColumn(
        "approver", F.when(F.col("risk_rank").isNull(), "APPROVER").otherwise(F.col("approver")))


def risk_score(risks: DataFrame) -> DataFrame:
    score = F.col("probability") * F.col("impact")
    return risks.withColumn("score", score).withColumn("severity", severity(score))


def formula_metric(df: DataFrame, formulas: list[tuple[str, str]]) -> DataFrame:
    """Rates from governed formulas of the form ``a / b`` over columns of the frame."""
    out = df
    for name, formula in formulas:
        if not re.fullmatch(r"[a-z_]+ / [a-z_]+", formula):
            raise ValueError(f"formula not allowed: {formula}")
        num, den = formula.split(" / ")
        out = out.withColumn(name, F.try_divide(F.col(num).cast("double"),
                                                F.col(den).cast("double")))
    return out


def _marked(words: Column) -> Column:
    """Every word between spaces of its own, so that phrases match whole words and may touch."""
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")


def glossary_tag(docs: DataFrame, terms: DataFrame, ident: str, text: str, limit: int = 1_000_000
                 ) -> DataFrame:
    """Glossary terms of any number of words per document, with their number of occurrences.

    Terms and texts are compared by their words. An occurrence inside that of a longer term does not
    count; terms that only overlap do. Terms of equal words are one, the first; terms without a word
    and null texts match nothing. One automaton holds all terms, so a text is read once whatever
    their number; a glossary of more than ``limit`` terms is an error.
    """
    listed = terms.select("term", _marked(tokens("term")).alias("_m")).filter("_m <> ''").groupBy("_m").agg(
        F.min("term").alias("term")).limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} glossary terms")
    phrases = sorted((r["_m"], r["term"]) for r in listed)
    rows = docs.select(ident, _marked(tokens(text)).alias("_t")).filter("_t <> ''")
    kind = rows.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, (phrase, _) in enumerate(phrases):
            automaton.add_word(phrase, (i, len(phrase)))
        automaton.make_automaton()
        for batch in batches:
            where, which, count = [], [], []
            for row, words in enumerate(batch.column(1).to_pylist()):
                found, upto = Counter(), -1
                spans = sorted((end - size, -end, i) for end, (i, size) in automaton.iter(words))
                for _, end, i in spans:
                    if -end > upto:
                        found[i] += 1
                        upto = -end
                for i, n in found.items():
                    where.append(row)
                    which.append(phrases[i][1])
                    count.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(which, pa.string()),
                 pa.array(count, pa.int64())], names=[ident, "term", "n"])

    if not phrases:
        return rows.select(ident, F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    found = rows.mapInArrow(run, f"`{ident}` {kind}, term string, n long")
    return found.groupBy(ident, "term").agg(F.sum("n").alias("n"))


def classify_sensitivity(docs: DataFrame, text: str, patterns: dict[str, str] = SENSITIVE
                         ) -> DataFrame:
    """Strongest data class whose pattern occurs anywhere in the text."""
    low = F.lower(text)
    label = F.lit("PUBLIC")
    for name, pattern in patterns.items():
        label = F.when(low.rlike(pattern), name).otherwise(label)
    level = F.element_at(F.create_map(*[x for k, v in CLASS_LEVEL.items()
                                        for x in (F.lit(k), F.lit(v))]), label)
    return docs.withColumn("data_class", label).withColumn("level", level)


def flag_untrusted(pages: DataFrame, html: str, patterns: list[str] = INSTRUCTIONS) -> DataFrame:
    """Visible text of external pages and whether it carries instructions; the text stays data."""
    body = F.regexp_replace(F.lower(html), r"(?s)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    visible = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))
    hits = F.array_compact(F.array(*[F.when(F.col("visible").rlike(p), F.lit(i))
                                     for i, p in enumerate(patterns)]))
    out = pages.withColumn("visible", visible).withColumn("n_patterns", F.size(hits))
    return out.withColumn("untrusted", F.lit(True)).withColumn(
        "carries_instructions", F.col("n_patterns") > 0)

"""Governed constants and small rule tables.

Every table here is a fixed literal: its size is known, so joining it broadcast is always safe.
"""

from __future__ import annotations

# Enumerations of the data model.
ZONES = ["LANDING", "RAW", "STANDARDIZED", "CURATED", "DATA_PRODUCTS"]
WORKFLOW_STATES = ["DRAFT", "IN_PREPARATION", "SUBMITTED", "UNDER_REVIEW", "RETURNED", "VALIDATED",
                   "APPROVED", "IN_EXECUTION", "REVISED", "CLOSED", "ARCHIVED"]
SCENARIOS = ["BASELINE", "BUDGET_CEILING", "OPTIMISTIC", "CONSTRAINED", "CUSTOM"]
QUALITY_DIMENSIONS = ["completeness", "validity", "accuracy", "consistency", "uniqueness",
                      "timeliness", "integrity"]
CATEGORIES = ["WORKS", "SUPPLIES", "SERVICES", "INTELLECTUAL_SERVICES_FIRM",
              "INTELLECTUAL_SERVICES_INDIVIDUAL", "OTHER"]
CRITERIA = ["Relevance", "Coherence", "Effectiveness", "Efficiency", "Impact", "Sustainability"]
AUDIT_PIECES = ["PPM", "Need", "Costing", "DAO", "Publications", "Evaluation", "Award", "Contract",
                "Guarantees", "Reception", "Payments"]
MATURITY_DIMENSIONS = ["strategic", "technical", "economic", "environmental", "land", "funding",
                       "procurement"]
INVESTMENT_STAGES = ["IDEA", "SCREENING", "FEASIBILITY", "APPRAISAL", "ELIGIBILITY",
                     "PROJECT_BANK", "PRIORITIZATION", "PIP", "EXECUTION", "EX_POST"]
FUNDING_SOURCES = ["National Budget", "Loan", "Grant", "Counterpart", "Special Fund"]

# Formula constants.
PRICE_GAP_LIMIT = 0.20
MAD_FACTOR = 3 * 1.4826
SPLITTING_DAYS = 90
SPLITTING_LIMIT = 50_000
FUSION_CONSTANT = 60
BM25_K1, BM25_B = 1.2, 0.75
STAGE_DAYS = {"preparation": 30, "launch": 30, "evaluation": 20, "award": 10, "contract": 15,
              "delivery": 60}
TODAY = "1999-06-30"  # reporting date of the registered queries
FINAL_YEAR = 2001

# Bounds of the rule that builds the threshold table.
_BAND_BASE = {"WORKS": 60000, "SUPPLIES": 40000, "SERVICES": 45000,
              "INTELLECTUAL_SERVICES_FIRM": 30000, "INTELLECTUAL_SERVICES_INDIVIDUAL": 20000,
              "OTHER": 50000}
_PERIODS = [("1990-01-01", "1998-01-01", 100), ("1998-01-01", None, 120)]
_AUTHORITIES = [("MINISTRY", "DIRECTORATE", 100), ("AGENCY", "CELL", 80)]
_REGIMES = [("NATIONAL", 100), ("WORLD_BANK", 150)]


def _thresholds() -> list[tuple]:
    rows = []
    for category, base in _BAND_BASE.items():
        for authority, control, a_pct in _AUTHORITIES:
            for regime, r_pct in _REGIMES:
                for n, (start, end, p_pct) in enumerate(_PERIODS, 1):
                    top = base * a_pct * r_pct * p_pct // 1_000_000
                    legal = f"{regime}-ACT-{n}"
                    for procedure, low, high in (
                            ("QUOTATION", 0, top // 2), ("RESTRICTED_TENDER", top // 2, top),
                            ("OPEN_TENDER", top, None)):
                        rows.append(("NATIONAL", authority, category, regime, procedure, low, high,
                                     control, start, end, legal))
    return rows


# name -> (columns with types, rows). Fixed values.
TABLES: dict[str, tuple[list[tuple[str, str]], list[tuple]]] = {
    "program_factor": ([("program", "string"), ("factor", "decimal(4,2)")], [
        ("AUTOMOBILE", 0.50), ("BUILDING", 0.55), ("FURNITURE", 0.60), ("HOUSEHOLD", 0.65),
        ("MACHINERY", 0.70)]),
    "category_map": ([("resource_type", "string"), ("category", "string")], [
        ("ECONOMY", "SUPPLIES"), ("STANDARD", "SERVICES"), ("PROMO", "INTELLECTUAL_SERVICES_FIRM"),
        ("SMALL", "INTELLECTUAL_SERVICES_INDIVIDUAL"), ("MEDIUM", "OTHER"), ("LARGE", "WORKS")]),
    "funding_map": ([("priority", "string"), ("funding_source", "string"), ("regime", "string")], [
        ("1-URGENT", "National Budget", "WORLD_BANK"), ("2-HIGH", "Loan", "NATIONAL"),
        ("3-MEDIUM", "Grant", "NATIONAL"), ("4-NOT SPECIFIED", "Counterpart", "NATIONAL"),
        ("5-LOW", "Special Fund", "NATIONAL")]),
    "authority_map": ([("institution_id", "int"), ("authority_type", "string")], [
        (0, "MINISTRY"), (1, "AGENCY"), (2, "MINISTRY"), (3, "AGENCY"), (4, "MINISTRY")]),
    "threshold": ([("jurisdiction", "string"), ("authority_type", "string"),
                   ("category", "string"), ("regime", "string"), ("procedure", "string"),
                   ("lower_bound", "decimal(18,2)"), ("upper_bound", "decimal(18,2)"),
                   ("control_authority", "string"), ("valid_from", "date"), ("valid_to", "date"),
                   ("legal_source", "string")], _thresholds()),
    "retention": ([("data_class", "string"), ("days", "int")], [
        ("PUBLIC", 3650), ("INTERNAL", 1825), ("RESTRICTED", 1095), ("CONFIDENTIAL", 730),
        ("CRITICAL", 365)]),
    "data_class": ([("priority", "string"), ("data_class", "string"), ("level", "int")], [
        ("5-LOW", "PUBLIC", 0), ("4-NOT SPECIFIED", "INTERNAL", 1), ("3-MEDIUM", "RESTRICTED", 2),
        ("2-HIGH", "CONFIDENTIAL", 3), ("1-URGENT", "CRITICAL", 4)]),
    "state_map": ([("kind", "string"), ("state", "string"), ("step", "string")], [
        ("signup", "DRAFT", "PREPARE"), ("click", "SUBMITTED", "PREPARE"),
        ("view", "UNDER_REVIEW", "CHECK"), ("error", "RETURNED", "CHECK"),
        ("purchase", "APPROVED", "APPROVE")]),
    "allowed_transition": ([("from_state", "string"), ("to_state", "string")], [
        ("DRAFT", "SUBMITTED"), ("SUBMITTED", "UNDER_REVIEW"), ("UNDER_REVIEW", "RETURNED"),
        ("UNDER_REVIEW", "APPROVED"), ("RETURNED", "SUBMITTED"), ("RETURNED", "DRAFT"),
        ("APPROVED", "DRAFT")]),
    "indicator": ([("indicator", "string"), ("label", "string"), ("type", "string"),
                   ("definition", "string"), ("formula", "string"), ("unit", "string"),
                   ("baseline", "double"), ("source", "string"), ("frequency", "string"),
                   ("direction", "string"), ("program", "string")], [
        ("click", "Requests", "ACTIVITY", "requests handled", "avg(value)", "index", 20.0, "log",
         "DAILY", "HIGHER", "AUTOMOBILE"),
        ("view", "Consultations", "ACTIVITY", "files read", None, "index", 20.0, "log", "DAILY",
         "HIGHER", "AUTOMOBILE"),
        ("signup", "Beneficiaries", "OUTPUT", "new beneficiaries", "avg(value)", "index", None,
         "log", "WEEKLY", "HIGHER", "BUILDING"),
        ("purchase", "Services delivered", "OUTCOME", "services delivered", "avg(value)", "index",
         19.0, "log", "DAILY", "HIGHER", "FURNITURE"),
        ("error", "Incidents", "OUTPUT", None, "avg(value)", "index", 21.0, None, "DAILY",
         "LOWER", "HOUSEHOLD")]),
    "indicator_target": ([("indicator", "string"), ("week", "int"), ("target", "double")], [
        (name, week, base + step * week) for name, base, step in (
            ("click", 20.0, 0.25), ("view", 20.0, 0.5), ("purchase", 19.0, 0.75),
            ("error", 21.0, -0.5)) for week in range(1, 6)]),
    "source_precedence": ([("source", "string"), ("precedence", "int"), ("weight", "double")], [
        ("OFFICIAL", 1, 1.0), ("COSTING_REFERENCE", 2, 0.875), ("CONTRACT", 3, 0.75),
        ("INTERNAL", 4, 0.5), ("MARKET", 5, 0.375), ("ESTIMATE", 6, 0.25)]),
    "template": ([("execution_mode", "string"), ("step", "int"), ("task_label", "string"),
                  ("offset_days", "int")], [
        ("INDIRECT", 1, "Terms of reference", 0), ("INDIRECT", 2, "Tender", 30),
        ("INDIRECT", 3, "Works", 60), ("MIXED", 1, "Preparation", 0), ("MIXED", 2, "Workshop", 15),
        ("MIXED", 3, "Report", 45)]),
    "calendar_national": ([("event", "string"), ("deadline", "date"), ("actor", "string"),
                           ("instrument", "string"), ("legal_source", "string")], [
        ("CALL", "1999-02-01", "MINISTER", "DPPD", "LAW-1"),
        ("CEILINGS", "1999-04-15", "MINISTER", "PAP", "LAW-1"),
        ("CONFERENCE", "1999-06-15", "DPAF", "PTAB", "LAW-2"),
        ("ARBITRATION", "1999-08-01", "MINISTER", "PTAB", "LAW-2"),
        ("PLAN", "1999-10-01", "PRMP", "PPM", "LAW-3"),
        ("CONSUMPTION", "1999-12-01", "DPAF", "PCC", "LAW-3")]),
    "config_national": ([("key", "string"), ("value", "string"), ("locked", "boolean")], [
        ("currency", "XOF", True), ("late_days", "30", False), ("gap_limit", "0.20", False),
        ("language", "fr", True)]),
    "config_institution": ([("institution_id", "int"), ("key", "string"), ("value", "string")], [
        (0, "late_days", "45"), (1, "gap_limit", "0.15"), (2, "currency", "EUR")]),
    "config_program": ([("program", "string"), ("key", "string"), ("value", "string")], [
        ("BUILDING", "late_days", "60"), ("MACHINERY", "language", "en")]),
    "action_rule": ([("kind", "string"), ("risk_class", "string"), ("risk_rank", "int"),
                     ("approver", "string")], [
        ("view", "R0", 0, None), ("click", "R1", 1, None), ("signup", "R2", 2, "OWNER"),
        ("error", "R3", 3, "CONTROLLER"), ("purchase", "R4", 4, "APPROVER")]),
    "route": ([("signal_type", "string"), ("channel", "string"), ("recipient_role", "string")], [
        ("PLANNING", "inbox", "RPRO"), ("BUDGET", "inbox", "DPAF"), ("BUDGET", "email", "SGM"),
        ("PROCUREMENT", "inbox", "PRMP"), ("CONTRACT", "inbox", "PRMP"),
        ("PHYSICAL", "inbox", "RPRO"), ("INDICATOR", "email", "DPPD"),
        ("RISK", "inbox", "AUDITOR")]),
    "cause_map": ([("cause_no", "int"), ("cause", "string")], [
        (0, "budget"), (1, "procurement"), (2, "technical"), (3, "administrative"),
        (4, "external"), (5, "data")]),
    "tag_map": ([("digit", "int"), ("tag", "string")], [
        (0, "gender"), (1, "climate"), (2, "social"), (3, "child"), (4, "disability"), (5, "sdg"),
        (6, "gender"), (7, "climate"), (7, "sdg")]),
    "growth": ([("program", "string"), ("rate_pct", "int")], [
        ("AUTOMOBILE", 2), ("BUILDING", 3), ("FURNITURE", 4), ("HOUSEHOLD", 5),
        ("MACHINERY", 6)]),
    "glossary": ([("term", "string"), ("definition", "string")], [
        ("ae", "authorisation to commit"), ("cp", "payment credit"),
        ("pap", "annual performance plan"), ("nation", "national level"),
        ("annual performance plan", "what a program commits to for a year"),
        ("authorisation to commit", "ceiling of the commitments of a year"),
        ("payment credit", "ceiling of the payments of a year"),
        ("public procurement", "purchases under the procurement rules"),
        ("medium term expenditure framework", "ceilings of several years")]),
    "imputation_rule": ([("resource_type", "string"), ("allowed", "string")], [
        ("ECONOMY", "SUPPLIES"), ("ECONOMY", "OTHER"), ("STANDARD", "SERVICES"),
        ("STANDARD", "SUPPLIES"), ("PROMO", "SERVICES"), ("SMALL", "SUPPLIES"),
        ("MEDIUM", "SUPPLIES"), ("LARGE", "WORKS")]),
    "keyword_category": ([("keyword", "string"), ("category", "string")], [
        ("plate", "SUPPLIES"), ("bolt", "SUPPLIES"), ("gear", "SUPPLIES"), ("anvil", "WORKS"),
        ("rod", "WORKS"), ("widget", "SERVICES"), ("gizmo", "INTELLECTUAL_SERVICES_FIRM"),
        ("ring", "OTHER")]),
    "agent_limit": ([("max_steps", "int"), ("max_cost", "decimal(18,2)"), ("max_tools", "int")],
                    [(40, 1000.00, 30)]),
    "readiness_weight": ([("dimension", "string"), ("weight", "int")], [
        ("financing", 3), ("specifications", 2), ("studies", 1), ("site", 1), ("documents", 2),
        ("validation", 1)]),
    "metric": ([("metric", "string"), ("formula", "string")], [
        ("discount_rate", "discount_cents / gross_cents"),
        ("unit_cost", "gross_cents / quantity"),
        ("closed_share", "closed_lines / n_lines")]),
    "invalid_rule": ([("rule", "string"), ("dimension", "string"), ("severity", "string"),
                      ("owner", "string"), ("max_rate", "double")], [
        ("quantity_over_45", "validity", "WARNING", "steward", 0.05),
        ("discount_at_limit", "accuracy", "INFO", "steward", 0.5),
        ("work_before_start", "consistency", "CRITICAL", "owner", 0.1)]),
}


def values_sql(name: str) -> str:
    """The table as a SELECT over VALUES, readable by any SQL engine."""
    columns, rows = TABLES[name]

    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(c for c, _ in columns)
    kinds = {"string": "VARCHAR(200)"}
    casts = ", ".join(c if t == "string" else f"CAST({c} AS {kinds.get(t, t)}) AS {c}"
                      for c, t in columns)
    return f"SELECT {casts} FROM (VALUES {body}) AS t({names})"


def rule(spark, name: str):
    return spark.sql(values_sql(name))

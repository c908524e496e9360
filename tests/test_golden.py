"""Worked examples and edge rows on tiny literal frames; brute force for the searches."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fiscalarc.functions import columns as C
from fiscalarc.operators import aggregates as A
from fiscalarc.operators import content, derive, filters, graph, joins, ranking, retrieval, sets, windows
from fiscalarc.sources import ingest
from fiscalarc.sources import rules as R


def D(x):
    return Decimal(str(x))


def test_funding_gap(spark):
    needs = spark.sql("SELECT 'a' AS k, CAST(500 AS DECIMAL(18,2)) AS need")
    funds = spark.sql("SELECT * FROM VALUES ('a', 'National Budget', 300.00), ('a', 'Grant', 150.00) "
                      "AS t(k, funding_source, amount)")
    row = A.funding_plan(needs, funds, "k", R.FUNDING_SOURCES).first()
    assert row["gap"] == 50 and row["Loan"] == 0


def test_authorisation_equals_credits(spark):
    projects = spark.sql("SELECT 'p' AS k, CAST(10 AS DECIMAL(18,2)) AS ae")
    cp = spark.sql("SELECT * FROM VALUES ('p', 2028, 2.00), ('p', 2029, 5.00), ('p', 2030, 3.00) "
                   "AS t(k, year, cp)")
    row = A.ae_cp_profile(projects, cp, "k", [2028, 2029, 2030]).first()
    assert row["balanced"] and row["cp_2029"] == 5
    late = cp.unionByName(spark.sql("SELECT 'p' AS k, 2040 AS year, 1.00 AS cp"))
    assert not A.ae_cp_profile(projects, late, "k", [2028, 2029, 2030]).first()["balanced"]


def test_price_gap_flag_and_zero_reference(spark):
    lines = spark.sql("SELECT * FROM VALUES (70000000L, 52500000L), (1L, 0L) AS t(unit_cents, ref_cents)")
    rows = {r["ref_cents"]: r for r in windows.price_gap(lines, 0.2).collect()}
    assert rows[52500000]["gap"] == pytest.approx(1 / 3) and rows[52500000]["justify"]
    assert rows[0]["gap"] is None and not rows[0]["justify"]


def test_quarter(spark):
    s = spark.sql("SELECT DATE'2027-01-05' AS period, 10.00 AS planned_amount UNION ALL "
                  "SELECT DATE'2027-02-05', 15.00 UNION ALL SELECT DATE'2027-03-31', 35.00")
    row = A.pcc_quarterly(s, []).first()
    assert (row["quarter"], row["amount"]) == (1, 60)


def test_physical_determinants(spark):
    line = spark.sql("SELECT 60 AS participants, 3 AS days, CAST(1000 AS DECIMAL(18,2)) AS unit_price")
    assert filters.cost_lines(line, ["participants", "days"]).first()["cost"] == 180000


def test_aliases_make_one_entity(spark):
    names = spark.sql("SELECT * FROM VALUES (1L, 'MCV'), (2L, 'Ministère du Cadre'), "
                      "(3L, 'Ministere  du cadre'), (4L, 'Ministère du Cadr'), (5L, 'Autre Service') "
                      "AS t(id, name)")
    aliases = spark.sql("SELECT 'MCV' AS alias, 'Ministère du Cadre' AS canonical")
    got = {r["id"]: r["entity"] for r in graph.resolve_entities(names, "id", "name", aliases).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}


def test_plan_diff_labels(spark):
    old = spark.sql("SELECT * FROM VALUES (1, 10.00, DATE'2027-01-01', 'x'), (2, 10.00, DATE'2027-01-01', 'x'), "
                    "(3, 10.00, DATE'2027-01-01', 'x'), (4, 10.00, DATE'2027-01-01', 'x'), "
                    "(6, 1.00, DATE'2027-01-01', 'x') AS t(id, allocation, start_date, task)")
    new = spark.sql("SELECT * FROM VALUES (1, 11.00, DATE'2027-01-01', 'x'), (2, 10.00, DATE'2027-02-01', 'x'), "
                    "(3, 10.00, DATE'2027-01-01', 'y'), (5, 10.00, DATE'2027-01-01', 'x'), "
                    "(6, 1.00, DATE'2027-01-01', 'x') AS t(id, allocation, start_date, task)")
    got = {r["id"]: r["change"] for r in joins.plan_diff(old, new, ["id"]).collect()}
    assert got == {1: "amount", 2: "period", 3: "task", 4: "removed", 5: "added"}


def test_role_changes_hands_on_the_day(spark):
    roles = spark.sql("SELECT * FROM VALUES ('DPAF', 1L, DATE'2027-01-01', DATE'2027-03-01'), "
                      "('DPAF', 2L, DATE'2027-03-01', CAST(NULL AS DATE)) AS t(role, person_id, valid_from, valid_to)")
    events = spark.sql("SELECT 'DPAF' AS role, d FROM VALUES (DATE'2026-12-31'), (DATE'2027-02-28'), "
                       "(DATE'2027-03-01') AS t(d)")
    got = {str(r["d"]): r["person_id"] for r in joins.role_holder_at(events, roles, "role", "d").collect()}
    assert got == {"2026-12-31": None, "2027-02-28": 1, "2027-03-01": 2}


def test_rule_in_force(spark):
    texts = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01', DATE'2027-06-01'), "
                      "(2, DATE'2027-06-01', CAST(NULL AS DATE)) AS t(v, valid_from, valid_to)")
    assert [r["v"] for r in filters.valid_at(texts, "2027-06-01").collect()] == [2]
    assert [r["v"] for r in filters.valid_at(texts, "2027-05-31").collect()] == [1]


def test_launch_soon_and_file_not_ready(spark):
    files = spark.sql("SELECT 'P' AS program, 1 AS id, 20 AS days, false AS ready UNION ALL SELECT 'P', 2, 20, true")
    got = sets.signals(files, "PROCUREMENT", (F.col("days") <= 20) & ~F.col("ready"), "program", "id",
                       F.lit(4), F.lit(4)).collect()
    assert [(r["object_id"], r["severity"]) for r in got] == [("1", "CRITICAL")]


@pytest.mark.parametrize("weights", [None, "w"])
def test_spread_loses_no_cent(spark, weights):
    facts = spark.sql("SELECT 1 AS id, DATE'2027-11-30' AS start, 3 AS months, CAST(100.00 AS DECIMAL(18,2)) "
                      "AS amount, array(1.0D, 2.0D, 4.0D) AS w")
    rows = derive.spread_schedule(facts, "start", "months", "amount", weights).orderBy("period").collect()
    assert sum(r["planned_amount"] for r in rows) == 100
    assert [str(r["period"]) for r in rows] == ["2027-11-01", "2027-12-01", "2028-01-01"]
    assert rows[-1]["planned_amount"] == (D("33.34") if weights is None else D("57.15"))


def test_shift_at_month_end_and_leap_day(spark):
    s = spark.sql("SELECT 1 AS id, DATE'2028-01-31' AS period, CAST(5 AS DECIMAL(18,2)) AS planned_amount")
    moves = spark.sql("SELECT 1 AS id, 1 AS months")
    got = {r["month"]: (r["before"], r["after"]) for r in
           derive.shift_schedule(s, moves, "id", []).collect()}
    assert got == {"2028-01": (5, 0), "2028-02": (0, 5)}


def test_quarantine_keeps_every_row(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 5), (2, CAST(NULL AS INT)), (3, -1) AS t(id, v)")
    ok, bad = filters.quarantine(df, {"negative": F.col("v") < 0})
    assert ok.count() + bad.count() == 3 and bad.first()["reasons"] == ["negative"]


def test_cdc_last_change_wins(spark):
    base = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(id, v)")
    feed = spark.sql("SELECT * FROM VALUES (1, 'c', 'U', 5), (1, 'd', 'U', 6), (2, 'b', 'D', 7), (3, 'n', 'I', 1), "
                     "(4, 'x', 'I', 1), (4, 'x', 'D', 2) AS t(id, v, op, no)")
    assert {tuple(r) for r in ingest.apply_cdc(base, feed, ["id"], "no").collect()} == {(1, "d"), (3, "n")}


def test_import_rejects_what_does_not_cast(spark, tmp_path):
    (tmp_path / "in.csv").write_text("No,Amount\n1,10.5\nx,3\n3,-2\n")
    ok, bad = ingest.import_tabular(spark, str(tmp_path / "in.csv"),
                                    {"No": ("id", "bigint"), "Amount": ("amount", "double")},
                                    {"negative": F.col("amount") < 0})
    assert [r["id"] for r in ok.collect()] == [1]
    assert sorted(r["reasons"][0] for r in bad.collect()) == ["negative", "unreadable value"]


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("abc")
    row = ingest.read_document_files(spark, str(tmp_path)).first()
    assert row["text"] == "abc" and row["hash"].startswith("ba7816bf")


def test_earliest_finish_and_cycles(spark):
    tasks = spark.sql("SELECT * FROM VALUES ('a', 2), ('b', 3), ('c', 4), ('d', 1) AS t(task_id, duration)")
    deps = spark.sql("SELECT * FROM VALUES ('a', 'c'), ('b', 'c'), ('c', 'd') AS t(before_id, after_id)")
    got = {r["task_id"]: r["finish"] for r in graph.earliest_finish(tasks, deps).collect()}
    assert got == {"a": 2, "b": 3, "c": 7, "d": 8}
    with pytest.raises(ValueError):
        graph.earliest_finish(tasks, deps.unionByName(spark.sql(
            "SELECT 'd' AS before_id, 'a' AS after_id")))


def test_lineage_ends_on_a_cycle(spark):
    edges = spark.sql("SELECT * FROM VALUES ('a', 'b'), ('b', 'c'), ('c', 'a') AS t(src, dst)")
    got = graph.lineage_trace(edges, spark.sql("SELECT 'a' AS id"), "down").collect()
    assert sorted(r["node"] for r in got) == ["b", "c"]


def test_portfolio_is_the_best_set(spark):
    rng = random.Random(7)
    rows = [(f"i{g}", g * 100 + n, n == 0, D(rng.randint(100, 2000)) / 10, D(rng.randint(-20, 300)))
            for g in range(3) for n in range(12)]
    df = spark.createDataFrame(rows, "inst string, id long, mandatory boolean, total_cost decimal(18,2), "
                                     "score decimal(18,2)")
    caps = df.groupBy("inst").agg((F.sum("total_cost") * D("0.5")).cast("decimal(18,2)").alias("ceiling"))
    cap = {r["inst"]: r["ceiling"] for r in caps.collect()}
    for near in (1, 60):  # a tiny neighbourhood forces work onto the bound
        got = ranking.optimise_portfolio(df, caps, "inst", "id", near=near).collect()
        for inst, ceiling in cap.items():
            mine = [r for r in got if r["inst"] == inst]
            assert all(r["proven"] for r in mine) and any(r["mandatory"] for r in mine)
            assert sum(r["total_cost"] for r in mine) <= ceiling
            own = [r for r in rows if r[0] == inst]
            forced, free = [r for r in own if r[2]], [r for r in own if not r[2]]
            best = max(sum(x[4] for x in c) for k in range(len(free) + 1)
                       for c in itertools.combinations(free, k)
                       if sum(x[3] for x in c) + sum(x[3] for x in forced) <= ceiling)
            assert sum(r["score"] for r in mine if not r["mandatory"]) == best


def test_portfolio_of_like_projects_is_the_best_set(spark):
    """Even costs, an odd ceiling and one value per cost: no bound decides, all are undecided."""
    rng = random.Random(11)
    rows = [("i", n, False, D(2 * rng.randint(50, 900)) / 100) for n in range(150)]
    df = spark.createDataFrame(rows, "inst string, id long, mandatory boolean, total_cost decimal(18,2)")
    df = df.withColumn("score", (F.col("total_cost") * 3).cast("decimal(18,2)"))
    room = sum(int(r[3] * 100) for r in rows) // 4 * 2 + 1
    caps = spark.createDataFrame([("i", D(room) / 100)], "inst string, ceiling decimal(18,2)")
    reach = 1  # bit s is set if some set costs s cents
    for r in rows:
        reach |= reach << int(r[3] * 100)
    best = (reach & ((1 << (room + 1)) - 1)).bit_length() - 1
    got = ranking.optimise_portfolio(df, caps, "inst", "id").collect()
    assert sum(int(r["total_cost"] * 100) for r in got) == best
    assert all(r["proven"] for r in got)


def _jaccard(a, b, n=3):
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(12)]
    texts = []
    for i in range(60):  # a third are copies of one text, some with one word changed
        text = base[0] if i % 3 == 0 else base[i % 12]
        if i % 4 == 0:
            parts = text.split()
            parts[rng.randrange(40)] = "changed"
            text = " ".join(parts)
        texts.append((i, text))
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: (r["id_leader"], r["jaccard"]) for r in
           retrieval.near_duplicates(df, "id", "text", 0.7).collect()}
    text = dict(texts)
    for i in range(60):
        alike = [j for j in range(i) if _jaccard(text[i], text[j]) >= 0.7]
        assert (i in got) == bool(alike)
        if alike:
            assert got[i] == (alike[0], pytest.approx(_jaccard(text[i], text[alike[0]]), abs=1e-6))


def test_exact_search_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "The plan, of a year"), (2, "plan of"), (3, "x"), (4, "replan of a year ago")],
                                 "doc_id long, text string")
    asked = spark.createDataFrame([(1, "plan of"), (2, "X"), (3, "plan of a year ago now"), (4, "")],
                                  "query_id long, text string")
    got = {tuple(r) for r in retrieval.search_exact(docs, asked).collect()}
    assert got == {(1, 1), (1, 2), (2, 3)}


def test_labels_and_periods(spark):
    row = spark.sql("SELECT ' Éco-École  N°1 ' AS l, DATE'2028-02-29' AS d").select(
        C.normalise_label("l").alias("l"), C.period_bucket("d", "SEMI_ANNUAL").alias("s"),
        F.array_join(C.calendar_fields("d", F.lit("2028-07-01").cast("date")), ",").alias("q")).first()
    assert tuple(map(str, row)) == ("eco ecole n 1", "2028-01-01", "2028Q1,2028Q2,2028Q3")


def test_formula_must_be_allowed(spark):
    with pytest.raises(ValueError):
        content.formula_metric(spark.range(1), [("x", "id / 1; DROP")])


def test_rollover_and_overlay_leave_the_base(spark):
    base = spark.sql("SELECT 'a' AS k, 2027 AS fiscal_year, CAST(5 AS DECIMAL(18,2)) AS ceiling, "
                     "CAST(3 AS DECIMAL(18,2)) AS used")
    got = {r["fiscal_year"]: r["used"] for r in derive.new_year_rollover(base, 2028, ["ceiling"]).collect()}
    assert got == {2027: 3, 2028: 0}


def test_audit_chain_finds_removed_record(spark):
    log = spark.sql("SELECT 's' AS s, id, 'x' AS v FROM range(5)")
    sealed = windows.chain_hashes(log, "s", [F.col("id")], F.concat_ws("|", "id", "v"))
    bad = windows.verify_audit_chain(sealed.filter("id <> 2"), "s", [F.col("id")], F.concat_ws("|", "id", "v"))
    assert [r["id"] for r in bad.collect()] == [3]
    assert windows.verify_audit_chain(sealed, "s", [F.col("id")], F.concat_ws("|", "id", "v")).isEmpty()


def test_ragged_csv_rows_are_rejected_and_replayed(spark, tmp_path):
    (tmp_path / "in.csv").write_text("No,Amount\n1,5\n2,6,7\n3\n4,x\n")
    mapping, rules = {"No": ("no", "bigint"), "Amount": ("amount", "double")}, {}
    ok, bad = ingest.import_tabular(spark, str(tmp_path), mapping, rules)
    assert [tuple(r) for r in ok.collect()] == [(1, 5.0)]
    lines = {r["_line"]: r["reasons"] for r in bad.collect()}
    assert lines == {"2,6,7": ["wrong number of fields"], "3": ["wrong number of fields"],
                     "4,x": ["unreadable value"]}
    fixed = bad.withColumn("_line", F.when(F.col("_line") == "3", "3,8").otherwise(F.col("_line")))
    again, still = ingest.replay(fixed, ["No", "Amount"], mapping, rules)
    assert [tuple(r) for r in again.collect()] == [(3, 8.0)] and still.count() == 2


def test_script_text_is_not_visible(spark):
    page = "<script>if (a<b) x()</script ><!-- no --><style>p<q</style><p>Hello</p>"
    row = content.flag_untrusted(spark.createDataFrame([(page,)], "html string"), "html").first()
    assert row["visible"] == "hello"


def test_fingerprint_keeps_values_apart(spark):
    def of(a, b):
        df = spark.createDataFrame([(a, b)], "x string, y string")
        return ingest.dataset_fingerprint(df, ["x", "y"]).first()["fingerprint"]
    assert len({of("a|b", "c"), of("a", "b|c"), of(None, "a"), of("~", "a"), of("-", "a")}) == 5


def test_long_chains_are_connected(spark):
    chain = spark.range(1500).selectExpr("explode(array(id, id + 1)) AS item", "id AS key")
    found = graph.connected(chain, "item", "key")
    assert found.count() == 1501 and found.select("entity").distinct().collect() == [(0,)]


def test_deep_hierarchies_end_and_cycles_fail(spark):
    deep = spark.range(40).selectExpr("id AS c", "id + 1 AS p")
    assert graph.hierarchy_closure(deep, "c", "p").count() == 40 * 41 // 2
    with pytest.raises(ValueError):
        graph.hierarchy_closure(deep.unionByName(spark.sql("SELECT 40L AS c, 0L AS p")), "c", "p")


def test_weeks_of_different_months_stay_apart(spark):
    from types import SimpleNamespace

    from fiscalarc.plans.inputs import indicator_results
    from fiscalarc.sources.bindings import Tables

    rule = Tables(spark, "/root/testdata/sf0.001").rule
    kind = rule("indicator_target").filter("week = 1").first()["indicator"]
    event = spark.sql(f"SELECT '{kind}' AS kind, DATE'2024-01-02' AS day, 1.0D AS value UNION ALL "
                      f"SELECT '{kind}', DATE'2024-02-02', 5.0D")
    rows = indicator_results(SimpleNamespace(event=event, rule=rule)).orderBy("week").collect()
    assert [r["actual"] for r in rows] == [1.0, 5.0] and rows[1]["week"] - rows[0]["week"] == 5


def test_quality_scores(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1), (1, 1), (2, NULL), (3, 4) AS t(k, v)")
    row = A.quality_scores(df, {"complete": F.col("v").isNotNull()}, ["k"]).first()
    assert (row["n_rows"], float(row["complete"]), float(row["uniqueness"])) == (4, 0.75, 0.75)

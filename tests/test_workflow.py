import pytest
from pyspark.sql import functions as F

from marlstone.operators import fitting, matching, queue, telemetry, validators


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def evidence(spark):
    return rows(
        spark,
        [
            ("m1", "ACH Result 25% up to", "achievement_metric", None, ["up to 25", "do not attribute to LLM"], True), ("s1", "SQL for 5 years", "skill", "familiarity", [], True), ("x1", "plain", "section", None, ["Do not claim prophet"], False),
        ],
        "chunk_id string, text string, chunk_type string, proficiency string, constraints array<string>, cv_eligible boolean",
    )


def codes(spark, text, refs, location="experience[0].bullets[0]", allowed=("m1", "s1")):
    claims = rows(spark, [("d", location, text, refs)], "doc_id string, location string, text string, refs array<string>")
    ok = rows(spark, [("d", a) for a in allowed], "doc_id string, chunk_id string")
    return sorted(r["code"] for r in validators.claim_issues(claims, evidence(spark), ok).collect())


@pytest.mark.parametrize(
    "text,refs,location,want",
    [
        ("fine", ["s1"], "summary", []), ("x", [], "summary", ["missing_evidence_ref"]), ("10 years of x", ["s1", "zz"], "summary", ["unknown_evidence_ref"]),
        ("x", ["x1"], "summary", ["evidence_outside_match", "ineligible_evidence"]), ("6 years", ["s1"], "summary", ["unsupported_years_claim"]), ("4 years", ["s1"], "summary", []),
        ("6 años", ["s1"], "skills[0]", ["unsupported_years_claim"]), ("led a team of 5", ["s1"], "summary", ["unsupported_people_management"]), ("used ARIMA", ["s1"], "summary", ["unsupported_specialization"]),
        ("grew 30%", ["s1"], "summary", ["quantified_claim_without_metric"]), ("grew 30%", ["s1"], "skills[0]", []), ("grew up to 25%", ["m1"], "summary", []),
        ("grew 25%", ["m1"], "summary", ["metric_qualifier_lost"]), ("up to 30%", ["m1"], "summary", ["metric_value_not_in_evidence"]), ("LLM up to 25%", ["m1"], "summary", ["forbidden_metric_attribution"]),
        ("expert in SQL", ["s1"], "summary", ["proficiency_escalation"]), ("Prophet", ["x1"], "summary", ["evidence_boundary_violation", "evidence_outside_match", "ineligible_evidence"]),
    ],
)
def test_claims(spark, text, refs, location, want):
    got = codes(spark, text, refs, location)
    assert [c for c in got if c != "unsupported_specialization" or "unsupported_specialization" in want] == want


def test_language_and_structure(spark):
    docs = rows(spark, [("a", "en", "und", "x"), ("b", "es", "en", "el la los las con"), ("c", "en", "en", "the and")], "doc_id string, language string, expected string, text string")
    got = {(r["doc_id"], r["code"]) for r in validators.language_issues(docs).collect()}
    assert got == {("a", "language_undetermined"), ("b", "language_code_mismatch"), ("b", "language_content_mismatch")}
    s = rows(spark, [("a", 0, 2), ("b", 1, 19), ("c", 1, 3)], "doc_id string, n_experience int, n_bullets int")
    assert sorted(r["code"] for r in validators.structure_issues(s).collect()) == ["missing_experience", "too_few_bullets", "too_many_bullets"]


def test_letter_and_trace(spark):
    letters = rows(spark, [("d", "en", "es", "A", "A", "r", "r", "w " * 201, ["m1", "zz"])], "doc_id string, language string, expected_language string, company string, expected_company string, role string, expected_role string, text string, refs array<string>")
    refs = rows(spark, [("d", "m1")], "doc_id string, ref string")
    assert sorted(r["code"] for r in validators.letter_issues(letters, refs).collect()) == ["language_mismatch", "too_many_words", "unknown_evidence_ref"]
    t = rows(spark, [("t", "v", ["v::core"], ["r1"], ["a.json"], ["z.md"])], "trace_id string, vacancy_id string, chunk_ids array<string>, record_ids array<string>, chunk_paths array<string>, record_paths array<string>")
    ch = rows(spark, [("v", "v::core", ["a.json"])], "vacancy_id string, chunk_id string, source_paths array<string>")
    rec = rows(spark, [("r1", "p.md")], "record_id string, source_path string")
    assert [r["code"] for r in validators.trace_issues(t, ch, rec).collect()] == ["unsupported_record_path"]


def test_requirements(spark):
    r = rows(spark, [("v", ["Python", " SQL "], ["python", "Own it"], [], "Lead"), ("w", [], [" "], [], "Lead  role")], "vacancy_id string, tech_stack array<string>, requirements array<string>, responsibilities array<string>, role_title string")
    got = [(x["vacancy_id"], x["requirement"], x["requirement_type"]) for x in matching.requirements(r).orderBy("vacancy_id", "req_pos").collect()]
    assert got == [("v", "Python", "technology_or_capability"), ("v", "SQL", "technology_or_capability"), ("v", "Own it", "requirement"), ("w", "Lead role", "role_signal")]


HITS = "vacancy_id string, req_pos int, pos int, chunk_id string, record_id string, chunk_type string, proficiency string, score double, source_path string"


@pytest.mark.parametrize(
    "hits,want",
    [
        ([], "unsupported"), ([("c", "r", "skill", "core", 0.1)], "strong"), ([("c", "r", "skill", "working", 0.1), ("d", "q", "section", None, 0.1)], "strong"), ([("c", "r", "skill", "working", 0.1)], "weak"),
        ([("c", "r", "skill", "familiarity", 9.0)], "weak"), ([("c", "r", "section", None, 4.0)], "partial"), ([("c", "r", "section", None, 1.0)], "weak"), ([("c", "r", "section", None, 1.0), ("d", "q", "section", None, 1.0)], "partial"),
    ],
)
def test_coverage(spark, hits, want):
    reqs = rows(spark, [("v", 1, "Kafka", "t", "critical")], "vacancy_id string, req_pos int, requirement string, requirement_type string, importance string")
    h = rows(spark, [("v", 1, n, c, r, t, p, s, "f") for n, (c, r, t, p, s) in enumerate(hits, 1)], HITS)
    assert matching.coverage(reqs, h).first()["coverage"] == want


def test_coverage_with_verdicts_and_summary(spark):
    reqs = rows(spark, [("v", i, q, "t", "critical") for i, q in enumerate(("a", "b", "sql"), 1)], "vacancy_id string, req_pos int, requirement string, requirement_type string, importance string")
    h = rows(spark, [("v", 1, 1, "c", "r", "section", None, 80.0, "f", "related"), ("v", 2, 1, "d", "r", "section", None, 80.0, "f", "none"), ("v", 3, 1, "e", "r", "skill", "core", 90.0, "f", "direct")], HITS + ", support string")
    m = matching.coverage(reqs, h)
    assert [r["coverage"] for r in m.orderBy("req_pos").collect()] == ["weak", "unsupported", "strong"]
    s = matching.summary(m).first()
    assert (s["coverage_score"], s["strong"], s["unsupported"]) == (43.3, 1, 1)
    assert matching.resolve_mode("auto", True) == "hybrid"
    with pytest.raises(ValueError):
        matching.resolve_mode("x", True)


def test_queue(spark):
    q = rows(
        spark,
        [("a", 1, True, "f", "f", "PASS", True), ("b", 2, False, "f", None, None, True), ("c", 3, True, "f", None, None, False), ("d", 4, True, "f", "g", "PASS", True), ("e", 5, True, "f", "f", "DEFERRED_CAP", True), ("g", 6, True, "f", "f", "FAILED_REVIEW_REQUIRED", True)],
        "vacancy_id string, pos int, exists boolean, fingerprint string, previous_fingerprint string, previous_status string, eligible boolean",
    )
    plan = lambda **k: {r["vacancy_id"]: r["action"] for r in queue.plan_batch(q, 1, **k).collect()}
    assert plan() == {"a": "idempotent", "b": "missing", "c": "not_eligible", "d": "generate", "e": "deferred", "g": "idempotent"}
    assert plan(retry_failed=True)["g"] == "deferred"
    with pytest.raises(ValueError):
        queue.plan_batch(q, 0)


def test_union_budget_best(spark):
    a, b = rows(spark, [("x",), ("",)], "k string"), rows(spark, [("y",), ("x",)], "k string")
    assert [r["k"] for r in queue.ordered_union(b.filter("k = 'y'"), a, b, key="k").orderBy("pos").collect()] == ["y", "x"]
    r = rows(spark, [("d", i, s, i == 3) for i, s in enumerate((5, 4, 9, 1))], "d string, i int, size int, required boolean")
    kept = queue.budget_prefix(r, ["d"], [F.col("i")], "size", 40, 10)
    assert [x["i"] for x in kept.orderBy("i").collect()] == [0, 1]
    assert queue.cut_required(r, kept, "i").count() == 1
    c = rows(spark, [("d", n, True, s, 90, False) for n, s in enumerate((70, 91, 86, 91), 1)], "d string, iteration int, validators_pass boolean, overall_score int, evidence_score int, gate_passed boolean")
    assert queue.best_iteration(c, "d").first()["iteration"] == 2
    tiers = spark.range(1, 6).select(queue.escalation_tier(F.col("id")).alias("t")).collect()
    assert [t["t"] for t in tiers] == [1, 1, 2, 2, 3]


def test_usage(spark):
    calls = rows(spark, [("g", "a", 1000, 200, 100, 50, 1150), ("g", "b", 1, 0, 0, 0, 1), ("h", "a", 100, 200, 0, None, 100)], "g string, model string, prompt_tokens long, cached_input_tokens long, candidate_tokens long, reasoning_tokens long, total_tokens long")
    prices = rows(spark, [("a", 1.0, 0.1, 6.0)], "model string, input double, cached_input double, output double")
    out = {r["g"]: r for r in telemetry.usage(telemetry.cost(calls, prices), "g").collect()}
    assert out["g"]["estimated_cost_usd"] is None and out["g"]["known_estimated_cost_usd"] == 0.00172 and out["g"]["unpriced_models"] == ["b"]
    assert out["h"]["estimated_cost_usd"] == 0.00002
    guard = telemetry.CostGuard(1.0)
    guard.add(1.5)
    with pytest.raises(RuntimeError):
        guard.check()


def test_fitting(spark):
    items = rows(spark, [("d", n, s) for n, s in enumerate((5, 9, 3, 1))], "d string, at int, n int")
    assert {r["at"]: r["page"] for r in fitting.pack_first_page(items, "d", "at", "n", 4, 12).collect()} == {0: 1, 1: 2, 2: 1, 3: 2}
    doc = rows(spark, [("d", "skills", i, "x", i == 2) for i in range(3)] + [("d", "experience", 0, "y" * 200, False), ("d", "certifications", 0, "c", False)], "d string, section string, pos int, text string, sticky boolean")
    out = {(r["section"], r["pos"]): r["omitted"] for r in fitting.prune(doc, "d", 7).collect()}
    assert out == {("certifications", 0): True, ("skills", 2): False, ("skills", 1): True, ("skills", 0): False, ("experience", 0): False}
    t = rows(spark, [(1, "#111111", "#222222", "#eeeeee", "#ffffff", "#000000", "#333333")], "brand_id int, primary string, secondary string, accent string, surface string, text string, muted string")
    assert [r["passed"] for r in fitting.contrast_checks(t).collect()] == [True] * 5 + [False]


def test_gate(spark):
    good = ("PASS", 92, 90, 95, 95, 0, "PASS", "PASS", "PASS")
    schema = "decision string, overall_score int, vacancy_alignment int, evidence_strength int, language_quality int, n_blocking int, factual string, language string, structure string"
    r = validators.quality_gate(rows(spark, [good, ("REVISE", 91, 90, 95, 95, 1, "FAIL", "WARN", "PASS")], schema)).collect()
    assert r[0]["passed"] and r[1]["reasons"] == ["headhunter_decision_not_pass", "overall_score_below_92", "blocking_issues_present", "factual_validation_failed", "language_validation_failed"]


def test_prune_equals_item_by_item_removal(spark):
    """Random documents with ties, nulls and clashing extra columns against a walk over the items."""
    import random
    from math import ceil

    rnd = random.Random(3)
    least = {"experience": 1, "skills": 2}
    data = []
    for d in (*range(60), None):
        for _ in range(rnd.randint(1, 14)):
            data.append((d, rnd.choice([*fitting.PRIORITY, "summary", None]), rnd.randint(0, 4), rnd.choice(["", None, " x ", "y" * 30, "z" * 55]), rnd.choice([True, False, False, None]), len(data)))
    df = rows(spark, data, "d int, section string, pos int, text string, sticky boolean, n int").repartition(5)

    def brute(doc, budget):
        kept = list(doc)
        cost = lambda x: ceil(max(len((x[3] or "").strip()), 1) / 20)
        for section in fitting.PRIORITY:
            own = sorted((x for x in doc if x[1] == section), key=lambda x: (x[2], x[3] is not None, x[3] or ""), reverse=True)
            left = len(own)
            for x in own:
                if sum(map(cost, kept)) + len({y[1] for y in kept if y[1]}) <= budget or left <= least.get(section, 0):
                    break
                if not x[4]:
                    kept.remove(x)
                    left -= 1
        return kept

    for budget in (-1, 0, 5, 12, 200):
        out = fitting.prune(df, "d", budget, least, 20).collect()
        assert sorted(r["n"] for r in out) == list(range(len(data)))
        shape = lambda xs: sorted(map(repr, xs))
        want = [x[:5] for d in {x[0] for x in data} for x in brute([x for x in data if x[0] == d], budget)]
        assert shape(want) == shape(tuple(r)[:5] for r in out if not r["omitted"])
        assert all((r["reason"] is not None) == r["omitted"] for r in out)
    assert fitting.prune(df.limit(0), "d", 5).collect() == [] and fitting.prune(df, "d", 10**6).filter("omitted").count() == 0


def test_distinct_sources(spark):
    """The first of each path and entry in order, nulls as values, against a walk; a long list of copies."""
    import random

    from marlstone.operators import merge

    rnd = random.Random(5)
    lists = [[(rnd.choice(["a", "b", None]), rnd.choice([0, 1, None]), i) for i in range(n)] for n in (0, 1, 2, 30, 5000)]
    df = rows(spark, [(i, x) for i, x in enumerate([*lists, None])], "k int, refs array<struct<source_path:string,source_entry_index:int,n:int>>")
    for r in df.select("k", merge.distinct_sources(F.col("refs")).alias("v")).collect():
        seen = {}
        for p, e, n in lists[r["k"]] if r["k"] < len(lists) else []:
            seen.setdefault((p, e), (p, e, n))
        assert (r["v"] is None) if r["k"] == len(lists) else [tuple(x) for x in r["v"]] == list(seen.values())

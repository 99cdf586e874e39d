import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunks, config, context, dense, generation, hybrid, presentation, queue
from marlstone.sources import markdown, state


def line(text, *refs):
    return {"text": text, "evidence_refs": list(refs)}


def document(**over):
    return {
        "language": "en", "target_role": "Lead Engineer", "headline": line("Lead Engineer", "s1"), "summary": line("the and with for", "s1"),
        "experience": [{"organization": "Beta", "title": "Lead", "period": "2020", "evidence_refs": ["s1"], "bullets": [line("built x", "s1"), line("built y", "s1")]}, {"organization": "Alpha", "title": "Analyst", "period": "2010", "evidence_refs": ["s1"], "bullets": [line("did", "s1")]}],
        "projects": [], "skills": [line("GenAI", "s1")], "education": [line("MSc", "s1")], "certifications": [line("Cert", "s1")], **over,
    }


def frame(spark, *docs):
    return spark.createDataFrame([{"doc_id": str(i), **d} for i, d in enumerate(docs)], context.DOCUMENT)


def test_claims_in_order(spark):
    got = context.claims(frame(spark, document())).collect()
    assert [r["location"] for r in got] == ["headline", "summary", "experience[0].identity", "experience[0].bullets[0]", "experience[0].bullets[1]", "experience[1].identity", "experience[1].bullets[0]", "skills[0]", "education[0]", "certifications[0]"]
    assert got[2]["text"] == "Beta Lead 2020" and context.cited_refs(frame(spark, document())).count() == 1


def test_backbone_anchors_context(spark):
    ch = spark.createDataFrame(
        [("p::b", "profile", "B", ["B"], "", True, True), ("p::a", "profile", "A", ["A"], "", True, True), ("r::x", "role", "X", ["Chronology", "X"], "", True, True), ("r::y", "role", "Y", ["Y"], "", True, True), ("h", "profile", "A", ["A"], "", True, False), ("c", "certs", "T", ["T"], "the marker", True, True), ("m", "z", "Z", ["Z"], "", True, False), ("n", "z", "Z", ["Z"], "", False, True)],
        "chunk_id string, record_id string, title string, heading_path array<string>, text string, cv_eligible boolean, public_safe boolean",
    )
    stable = context.backbone(ch, (context.Backbone("profile", ("A", "B")), context.Backbone("role", headings=("Chronology",))))
    assert [r["chunk_id"] for r in stable.orderBy("pos").collect()] == ["p::a", "p::b", "r::x"]
    sticky = context.editorial_anchors(ch, context.Anchors(titles=("A",), markers=(("certs", "marker"),)))
    matched = spark.createDataFrame([("n", 1), ("m", 2), ("p::a", 3)], "chunk_id string, pos int")
    got = context.assemble(ch, stable, sticky, matched).orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == ["p::a", "p::b", "r::x", "c", "m"]


RULES = context.Editorial(identities=("lead engineer",), order=("beta", "alpha"), progression=("beta",), wanted_skill=("genai",), wanted_certifications={"c": ("cert",)})


def test_editorial(spark):
    ok = document(experience=[{**document()["experience"][0], "title": "Senior Expert"}, document()["experience"][1]])
    bad = document(target_role="Chef", headline=line("Chef"), experience=[document()["experience"][1], document()["experience"][0]], skills=[line("evidence unavailable")], certifications=[], education=[line(" ")])
    got = {(r["doc_id"], r["code"]) for r in context.editorial_issues(frame(spark, ok, bad), RULES).collect()}
    assert {c for d, c in got if d == "0"} == set()
    assert {c for d, c in got if d == "1"} == {
        "identity_outside_canonical_family", "alpha_order", "beta_progression_missing", "wanted_skill_missing", "mandatory_certification_missing_c", "certifications_missing", "empty_employer_facing_field", "diagnostic_language_exposed"
    }


def test_markdown_and_letter(spark):
    md = presentation.markdown(frame(spark, document(language="es"))).first()["markdown"]
    assert md.startswith("# Lead Engineer\n\n**Lead Engineer**\n\n## Resumen Profesional\n\nthe and with for\n\n## Experiencia\n\n### Lead — Beta\n*2020*\n\n- built x\n- built y\n\n### Analyst")
    assert "Proyectos" not in md and md.endswith("## Certificaciones\n\n- Cert\n")
    letters = spark.createDataFrame([("d", "Dear ", [" a", "b"], "Bye")], "doc_id string, salutation string, paragraphs array<string>, closing string")
    assert presentation.letter_markdown(letters).first()["markdown"] == "Dear\n\na\n\nb\n\nBye\n"
    assert spark.range(1).select(presentation.escape(F.lit("<a b=\"c\">'&")).alias("x")).first()["x"] == "&lt;a b=&quot;c&quot;&gt;&#x27;&amp;"


def test_config():
    assert presentation.company_slug("Ácme & Co") == "acme-co"
    assert presentation.resolve_brand("X", {}).verified is False
    with pytest.raises(ValueError):
        presentation.resolve_brand("X", {"x": {"company": "Y"}})
    with pytest.raises(ValueError):
        presentation.resolve_brand("X", {"x": {"company": "X", "source_kind": "official"}})
    with pytest.raises(ValueError):
        presentation.template("nope")
    values, source = presentation.resolve_identity({"name": "N", "github": "g"}, {"IDENTITY_GITHUB": " h ", "IDENTITY_EMAIL": "e"})
    assert values == {"name": "N", "github": "h"} and source["github"] == "environment"
    with pytest.raises(ValueError):
        presentation.resolve_identity({"name": "N"}, {}, with_private=True)
    with pytest.raises(ValueError):
        presentation.resolve_identity({"name": "N", "email": "e"}, {})
    assert presentation.resolve_identity({"name": "N"}, {"IDENTITY_EMAIL": "e"}, True, "private")[0]["email"] == "e"


def test_bundles_and_feed(spark):
    b = spark.createDataFrame([("a", True, True), ("b", False, True)], "doc_id string, quality_reached boolean, letter_ready boolean")
    t = spark.createDataFrame([("a", "primary", "FIT", "PASS", "PASS"), ("b", "alternate", "FIT", "PASS", "PASS")], "doc_id string, role string, fit_status string, design_status string, physical_status string")
    got = {r["doc_id"]: r for r in presentation.bundle_readiness(b, t).collect()}
    assert got["a"]["ready_to_send"] and len(got["b"]["reasons"]) == 4
    res = spark.createDataFrame([("v", "r"), ("w", None), ("x", "r"), ("y", "r"), ("z", "r")], "vacancy_id string, run_id string")
    out = spark.createDataFrame([("v", "r", True, None, None), ("x", "r", False, "brand", None), ("z", "r", False, None, "boom")], "vacancy_id string, run_id string, ready_to_send boolean, blocked string, error string")
    assert {r["vacancy_id"]: r["status"] for r in presentation.finalize(res, out).collect()} == {"v": "PASS", "w": "SKIPPED_NO_FRESH_OUTPUT", "x": "REVIEW_REQUIRED", "y": "SKIPPED_MISSING_OUTPUT", "z": "FAILED_PRESENTATION_GATE"}
    rec = "vacancy_id string, company string, role_title string, url string, fit_score double, fit_summary string, jd_fidelity string, location_raw string, city string, work_model string, provenance array<struct<source_path:string,source_search_date:string,source_updated_at:string>>"
    rows = [("v", "B", "r", "u", 5.0, None, "full", None, "Oslo", None, [("p/2026-01-02.json", None, None)]), ("w", "A", "r", "u", None, None, "full", "X", None, None, [("p", "2026-01-02", None)]), ("x", "A", "r", "u", 9.0, None, "full", "X", None, None, [("p", None, "2026-01-03T0")])]
    batch = spark.createDataFrame([("v", "r1", "PASS", False, 1), ("v", "r2", "PASS", True, 2)], "vacancy_id string, run_id string, status string, ready_to_send boolean, seq int")
    reports = spark.createDataFrame([("r2", 80.0, 95)], "run_id string, match_coverage_score double, overall_score int")
    f = presentation.feed(spark.createDataFrame(rows, rec), batch, reports, "2026-01-02").collect()
    assert [(r["vacancy_id"], r["generation_status"], r["location"]) for r in f] == [("v", "READY", "Oslo"), ("w", "NOT GENERATED", "X")]
    assert "READY" in presentation.feed_page("d", [r.asDict() for r in f])


class Fake:
    """Deterministic stand-in for a model: stated overall scores, one after the other."""

    def __init__(self, scores, usd=0.1):
        self.scores, self.usd, self.n = scores, usd, 0

    def call(self, task, tier, payload, max_output_tokens):
        if task == "strategist":
            return {"language": "en", "selected_evidence_chunk_ids": ["s1"]}, self.usd
        if task == "reviewer":
            s = self.scores[self.n]
            self.n += 1
            return {"decision": "PASS", "overall_score": s, "vacancy_alignment": 95, "evidence_strength": 96, "language_quality": 96}, self.usd
        return document(skills=[line(f"GenAI {self.n}", "s1")]), self.usd


def evidence(spark):
    return spark.createDataFrame([("s1", "x", "section", None, [], True)], "chunk_id string, text string, chunk_type string, proficiency string, constraints array<string>, cv_eligible boolean")


@pytest.mark.parametrize("scores,want", [([70, 91, 86, 91, 88], ("COMPLETED_BELOW_TARGET", 2)), ([70, 93], ("PASS", 2))])
def test_loop(spark, scores, want):
    rules = context.Editorial()
    out = generation.write(spark, Fake(scores), {"application_language": "en"}, evidence(spark), ["s1"], [], rules)
    assert (out.status, out.best_round) == want and out.document["skills"][0]["text"] == f"GenAI {want[1] - 1}"
    with pytest.raises(RuntimeError):
        generation.write(spark, Fake(scores, 1.1), {"application_language": "en"}, evidence(spark), ["s1"], [], rules, 2.0)


def test_batch(spark):
    q = spark.createDataFrame([("a", 1, True, "f", None, None, True), ("b", 2, True, "f", None, None, True), ("c", 3, True, "f", None, None, True)], "vacancy_id string, pos int, exists boolean, fingerprint string, previous_fingerprint string, previous_status string, eligible boolean")

    def generate(i):
        if i == "a":
            raise ValueError("no")
        return generation.Outcome("PASS", 1, {}, [], [], 0.5)

    got = generation.run_batch(q, 2, generate)
    assert [r["status"] for r in got] == ["FAILED_REVIEW_REQUIRED", "PASS", "DEFERRED_CAP"]
    with pytest.raises(ValueError):
        generation.check_strategy({"language": "es"}, set(), "en")


def test_letter(spark):
    record = {"application_language": "en", "company": "Acme ", "role_title": "Lead"}

    class Writer:
        def __init__(self, ref):
            self.ref = ref

        def call(self, task, tier, payload, tokens):
            return {"language": "en", "company": "ACME", "role": "lead", "paragraphs": [{"text": "hello", "evidence_refs": [self.ref]}]}, None

    assert generation.write_letter(spark, Writer("s1"), record, document())["company"] == "ACME"
    with pytest.raises(ValueError, match="unknown_evidence_ref"):
        generation.write_letter(spark, Writer("zz"), record, document())


def test_checked_config():
    for bad in (dict(order=("summary",)), dict(modes={"summary": "always"}), dict(modes=dict(config.Layout().modes) | {"experience": "never"})):
        with pytest.raises(ValueError):
            config.Layout(**bad)
    for bad in (dict(max_skills=9), dict(min_role_bullets=4, max_role_bullets=3)):
        with pytest.raises(ValueError):
            config.Density(**bad)
    tokens = {"primary": "p", "secondary": "s", "accent": "a", "text": "t", "muted": "m"}
    ok = {"decision": "PASS", "ats_safe": True, "print_safe": True}
    assert config.adapt_style(tokens, ok | {"primary_usage": "accents_only", "secondary_usage": "accents_only"}) == {"primary": "t", "secondary": "m", "accent": "p", "text": "t", "muted": "m"}
    with pytest.raises(ValueError):
        config.adapt_style(tokens, ok | {"ats_safe": False})
    config.render_gate(True, False, True, False)
    for bad in ((False, False, False, True), (False, True, True, False)):
        with pytest.raises(ValueError):
            config.render_gate(*bad)
    with pytest.raises(ValueError):
        config.check_review(ok, False)
    assert config.model_ids({"MODEL_A": "m-2"}, {"a": "m-1", "b": "m-3"}, "m-[0-9]") == {"a": "m-2", "b": "m-3"}
    with pytest.raises(ValueError):
        config.model_ids({}, {"a": "x"}, "m-[0-9]")


def test_queue_candidates(spark):
    entries = spark.createDataFrame([("d", "DEFERRED_CAP", 4), ("s", "PASS", 3), ("gone", "PASS", 3), ("n", "PASS", None)], "vacancy_id string, status string, logic_version int")
    records = spark.createDataFrame([("d",), ("s",), ("f",), ("n",)], "vacancy_id string")
    fresh = spark.createDataFrame([("s",), ("f",)], "vacancy_id string")
    assert [r["vacancy_id"] for r in queue.candidates(entries, records, fresh, 4).orderBy("pos").collect()] == ["d", "n", "s", "f"]


EV = [("skills::sql", "skills", "skill", "SQL\nx", "core", "s.md"), ("p::a", "p", "section", "spark kafka", None, "p.md"), ("q::a", "q", "section", "kafka", None, "q.md")]


def test_hybrid_modes(spark):
    ev = spark.createDataFrame(EV, "chunk_id string, record_id string, chunk_type string, text string, proficiency string, source_path string")
    q = spark.createDataFrame([(1, "spark sql")], "query_id int, text string")
    rel = spark.createDataFrame([("p", "links_to", "q")], "source string, relation string, target string")
    emb = dense.HashEmbedder(16)
    vec = spark.createDataFrame([(r[0], emb.embed([r[3]])[0][0]) for r in EV[:2]], "chunk_id string, vector array<double>")
    qv = spark.createDataFrame([(1, emb.embed(["spark sql"])[0][0])], "query_id int, vector array<double>")
    lex = hybrid.retrieve(q, ev, "lexical", 6).orderBy("pos").collect()
    assert {r["chunk_id"] for r in lex} == {"skills::sql", "p::a"}
    hyb = hybrid.retrieve(q, ev, "auto", 6, vec, qv, rel).orderBy("pos").collect()
    assert hyb[0]["chunk_id"] == "skills::sql" and hyb[0]["retrieval_source"] == "anchor" and (hyb[-1]["chunk_id"], hyb[-1]["retrieval_source"]) == ("q::a", "graph")
    verdict = lambda h: h.select("query_id", "chunk_id", F.col("pos").alias("verdict_pos"), F.lit(60).alias("relevance"), F.lit("direct").alias("support"), F.lit("").alias("reason"))
    assert {r["score"] for r in hybrid.retrieve(q, ev, "hybrid-rerank", 6, vec, qv, rel, verdict).collect()} == {60.0}
    with pytest.raises(ValueError):
        hybrid.retrieve(q, ev, "hybrid")
    assert [r["size"] for r in chunks.compact(ev).collect()] == [len(r["payload"]) for r in chunks.compact(ev).collect()]


def test_governance(spark, tmp_path):
    head = "---\nschema_version: 3\nrecord_id: {id}\nrecord_type: {t}\nstatus: canonical\nlast_updated: 2026-01-01\nconfidence: high\nvisibility: public\npublic_safe: true\nsource_refs: [{refs}]\n---\n"
    (tmp_path / "a.md").write_text(head.format(id="good-one", t="achievement_registry", refs="S1") + "## ACH-A-1 — x\n[l](b.md)\n")
    (tmp_path / "b.md").write_text(head.format(id="Bad_Id", t="skills", refs="S9") + "## S\n- **Level:** guru\nACH-ZZ\n[l](none.md)\n")
    from marlstone.operators import sections

    r = markdown.normalize(markdown.read_files(spark, str(tmp_path)))
    reg = spark.createDataFrame([("S1",)], "source_ref string")
    got = {(x["source_path"], x["code"]) for x in markdown.governance_issues(r, sections.relations(r), reg).collect()}
    assert got == {("b.md", c) for c in ("invalid_record_id", "invalid_skill_level", "unknown_metric", "unknown_source_ref", "broken_link")}
    m = {(x["retrieval_class"], x["record_type"]): x["n"] for x in markdown.manifest(r).collect()}
    assert m == {("evidence", None): 2, (None, "skills"): 1, (None, "achievement_registry"): 1, (None, None): 2}
    assert state.resolve_commit(str(tmp_path)) is None
    state.write_jsonl(r.select("source_path", "record_id"), str(tmp_path / "out"))
    assert '{"record_id":"good-one","source_path":"a.md"}' in [x[0] for x in spark.read.text(str(tmp_path / "out")).collect()]

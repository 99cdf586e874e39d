import json

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.operators import chunks, diff, fidelity, language, lexical, merge, sections
from marlstone.sources import feeds, markdown
from marlstone.sources.state import Conflict, StateStore, Transaction, latest
from marlstone.streaming import evidence, ingest

A = {"last_updated": "2026-01-01", "total_results": 1, "vacancies": [{"id": "1", "company": "Acme ", "role_title": "Lead Data Scientist", "tech_stack": ["Python", "python"], "location": {"city": "Oslo", "work_model": "Híbrido"}, "fit_score": 91}]}
B = {"metadata": {"fecha_busqueda": "2026-01-02"}, "vacantes": [{"id_vacante": "9", "puesto": "Lead Data Scientist", "empresa": "ACME", "ubicacion": "Oslo", "porcentaje_ajuste": 88.5, "stack_clave_detectado": ["Spark"]}]}


def put(root, **files):
    for name, doc in files.items():
        p = root / f"{name}.json"
        p.write_bytes(doc if isinstance(doc, bytes) else json.dumps(doc).encode())


def test_whole_file_rejected(spark, tmp_path):
    bad = {"total_results": 3, "vacancies": [{"company": "", "role_title": "x", "fit_score": True, "tech_stack": "no"}, 5]}
    put(tmp_path, a=A, b=bad, c=b"{", d=b"\xff", e={"other": []})
    rows = {r["source_path"]: r for r in feeds.check(feeds.envelope(feeds.read_files(spark, str(tmp_path)))).collect()}
    assert rows["a.json"]["errors"] == []
    assert len(rows["b.json"]["errors"]) == 5
    assert rows["c.json"]["errors"] == ["invalid JSON"] and rows["d.json"]["errors"] == ["file is not UTF-8"]
    assert rows["e.json"]["errors"][0].startswith("unsupported JSON envelope")


def test_runs_are_incremental(spark, tmp_path):
    data, store = tmp_path / "in", StateStore(spark, str(tmp_path / "state"))
    data.mkdir()
    run = lambda i: ingest.run_batch(spark, store, feeds.read_files(spark, str(data)), f"r{i}")
    put(data, a=A, b=B)
    first = run(1).counts
    assert (first["new"], first["impacted"], first["reindexed"], first["active"]) == (2, 1, 1, 1)
    one = store.read("merged", feeds.adapt(feeds.check(feeds.envelope(feeds.read_files(spark, str(data))))).schema).first()
    assert one["tech_stack"] == ["Python", "Spark"] and len(one["provenance"]) == 2
    second = run(2).counts
    assert (second["unchanged"], second["new"], second["modified"], second["impacted"], second["reindexed"]) == (2, 0, 0, 0, 0)
    put(data, a={**A, "vacancies": [{**A["vacancies"][0], "company": ""}]})
    third = run(3)
    assert third.status == "completed_with_quarantine" and third.counts["quarantined"] == 1 and third.counts["reindexed"] == 1
    (data / "b.json").unlink()
    last = run(4).counts
    assert (last["deleted"], last["deleted_entities"], last["active"]) == (1, 1, 0)
    assert latest(store.log("runs", ingest.RUNS)).first()["run_id"] == "r4"
    assert ingest.reindexed(store, "r1").count() == 1


def test_stream_front_door(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    put(data, a=A)
    seen = []
    for _ in range(2):
        q = ingest.watch(spark, str(data), str(tmp_path / "cp"), seen.append)
        q.awaitTermination(60)
    assert len(seen) == 1


def test_diff_partitions_paths(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "source_path string, source_hash string")
    new = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "1")], "source_path string, source_hash string")
    assert {tuple(r) for r in diff.snapshot_diff(old, new).collect()} == {("a", "deleted"), ("b", "unchanged"), ("c", "modified"), ("d", "new")}


@pytest.mark.parametrize(
    "title,body,explicit,want",
    [
        ("x", "the and with for", "Español", ("es", 1.0, "explicit_source")), ("x", "the and with", None, ("en", 0.81, "vacancy_text")), ("x", "el la los con para y", None, ("es", 0.9, "vacancy_text")),
        ("Lead Engineer", "", None, ("en", 0.86, "role_title")), ("Científico de datos", "", None, ("es", 0.9, "role_title")), ("x", "", "de", ("und", 0.0, "undetermined")),
        ("x", "", "fr_CA", ("fr", 1.0, "explicit_source")), ("x", "the the la", None, ("und", 0.0, "undetermined")),
    ],
)
def test_language(spark, title, body, explicit, want):
    df = spark.createDataFrame([(title, body, explicit)], "t string, b string, e string")
    r = df.select(language.infer_language(F.col("t"), F.col("b"), F.col("e")).alias("v")).first()["v"]
    assert (r["lang"], round(r["confidence"], 6), r["source"]) == want


@pytest.mark.parametrize("desc,req,want", [("", [], ("sparse", 0.0)), ("x" * 1200, [], ("full", 60.0)), ("x" * 300, [], ("partial", 15.0)), ("x" * 600, ["y" * 24] * 8, ("full", 70.0)), ("", ["y" * 23] * 20, ("sparse", 0.0))])
def test_fidelity(spark, desc, req, want):
    df = spark.createDataFrame([(desc, req)], "d string, r array<string>")
    r = df.select(fidelity.assess(F.col("d"), F.col("r"), F.array().cast("array<string>")).alias("v")).first()["v"]
    assert (r["fidelity"], r["score"]) == want


def test_merge_prefers_fuller_record(spark, tmp_path):
    rich = {**A, "vacancies": [{**A["vacancies"][0], "seniority": "Lead", "salary": "1"}]}
    put(tmp_path, z=rich, b=B)
    rows = feeds.adapt(feeds.check(feeds.envelope(feeds.read_files(spark, str(tmp_path)))))
    m = merge.merge_records(rows).first()
    assert m["salary"] == "1" and m["fit_score"] == 88.5 and m["tech_stack"] == ["Spark", "Python"]
    kinds = {r["chunk_type"]: r["text"] for r in chunks.posting_chunks(merge.merge_records(rows)).collect()}
    assert kinds["source-fit"].startswith("Source fit score: 88.5/100") and "Seniority: Lead" in kinds["core"]


MD = """---
record_id: p
record_type: project
status: active
public_safe: true
---
# Top
Intro ACH-ONE-1
## Usage boundary
Do not claim x
#### Deep
t [l](../y.md#z) [w](https://e.com/a.md)
## Summary
- **Status:** `ok`
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.md").write_text(MD)
    (tmp_path / "y.md").write_text('---\nrecord_id: skills\nrecord_type: skills\nstatus: active\npublic_safe: "true"\n---\n## Python\n- **Level:** Core\n## Other\nno\n')
    r = markdown.normalize(markdown.read_files(spark, str(tmp_path)))
    rows = {x["record_id"]: x for x in r.collect()}
    assert rows["p"]["public_safe"] and not rows["skills"]["public_safe"]
    sec = sections.sections(r)
    got = [(x["heading_path"], x["start_line"], x["end_line"], x["semantic_type"]) for x in sec.filter("record_id = 'p'").orderBy("pos").collect()]
    assert got == [(["Top"], 7, 8, "section"), (["Top", "Usage boundary"], 9, 10, "boundary"), (["Top", "Usage boundary", "Deep"], 11, 12, "section"), (["Top", "Summary"], 13, 14, "summary")]
    ch = {x["chunk_id"]: x for x in chunks.record_chunks(r, sec).collect()}
    assert ch["p::top"]["chunk_type"] == "project_detail" and ch["p::top"]["constraints"] == ["Do not claim x"]
    assert ch["skills::python"]["proficiency"] == "core" and "skills::other" not in ch
    assert {tuple(x) for x in sections.relations(r).collect()} == {("p", "references_metric", "ACH-ONE-1"), ("p", "links_to", "skills")}
    (tmp_path / "bad.md").write_text("no front matter")
    with pytest.raises(Exception, match="missing YAML front matter"):
        markdown.normalize(markdown.read_files(spark, str(tmp_path))).collect()


def test_heading_stack_against_loop(spark):
    import random

    draw = random.Random(3)
    rows, want = [], {}
    for f in range(30):
        stack = []
        for pos in range(12):
            level = draw.randint(1, 6)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, f"t{pos}"))
            rows.append((f, pos, level, f"t{pos}"))
            want[f, pos] = [t for _, t in stack]
    got = sections.hierarchy(spark.createDataFrame(rows, "f int, pos int, level int, title string"), "f").collect()
    assert {(r["f"], r["pos"]): r["heading_path"] for r in got} == want


def test_command_line(spark, tmp_path, capsys):
    data = tmp_path / "in"
    data.mkdir()
    put(data, a=A, b={"vacancies": [{"company": ""}]})
    assert cli.main(["ingest", str(data), str(tmp_path / "s"), "--run-id", "r1", "--fail-on-quarantine"], spark) == 2
    assert "quarantined=1" in capsys.readouterr().out
    assert cli.main(["retrieve", str(tmp_path / "s"), "python", "--top-k", "1"], spark) == 0
    assert capsys.readouterr().out.split()[2].endswith("::requirements")
    (tmp_path / "x.md").write_text(MD)
    assert cli.main(["validate", str(tmp_path)], spark) == 1
    assert "missing_field" in capsys.readouterr().out


def test_match_in_one_plan(spark, tmp_path):
    put(tmp_path, a=A)
    rows = feeds.adapt(feeds.check(feeds.envelope(feeds.read_files(spark, str(tmp_path)))))
    evidence = spark.createDataFrame([("skills::python", "skills", "skill", "Python\nlevel core", "core", "s.md"), ("p::x", "p", "section", "other", None, "p.md")], "chunk_id string, record_id string, chunk_type string, text string, proficiency string, source_path string")
    got = cli.match(rows, evidence).collect()
    assert [(r["requirement"], r["coverage"], r["evidence_chunk_ids"]) for r in got] == [("Python", "strong", ["skills::python"])]


def test_snapshot_survives_a_dead_run(spark, tmp_path):
    """A run that dies after its data and before its snapshot leaves the old one in force; what it wrote is never seen, and goes."""
    store = StateStore(spark, str(tmp_path))
    rows = lambda n: spark.range(n).select(F.col("id").cast("int").alias("x"))
    for n in (1, 2, 3):
        store.write("t", rows(n), "x")
    dead = store.begin()
    dead.write("t", rows(9), "x")
    assert store.snapshot().number == 3 and store.read("t", "x int").count() == 3
    store.write("t", rows(4), "x")
    with pytest.raises(Conflict):
        dead.commit()  # another run has committed since it began
    store.retain()
    assert store.read("t", "x int").count() == 4 and store.numbers() == [3, 4] and len(store.names("t")) == 2
    store.retain(0)
    assert sorted(r["x"] for r in store.current("t").collect()) == [0, 1, 2, 3] and len(store.names("t")) == 1
    store.wipe("t")
    assert store.current("t").collect() == [] and store.snapshot(4).tables["t"].folders
    with pytest.raises(ValueError, match="no table"):
        store.current("none")


class Died(Exception):
    pass


def dying(monkeypatch, after):
    """From now on a run dies after as many writes of tables."""
    left = [after]
    write = Transaction._put

    def put(self, *args):
        if left[0] == 0:
            raise Died
        left[0] -= 1
        return write(self, *args)

    monkeypatch.setattr(Transaction, "_put", put)


def contents(store, names=(*ingest.TABLES, *evidence.TABLES)):
    out = {}
    for n in names:
        rows = store.read(n, "x int")
        if n.endswith("frequencies"):
            rows = ingest.frequencies(rows) if rows.columns != ["x"] else rows
        out[n] = sorted(map(str, rows.select(*sorted(rows.columns)).collect()))
    return out


def test_a_run_that_dies_anywhere_is_done_again(spark, tmp_path, monkeypatch):
    """A run writes ten tables and then its snapshot; it dies before the first write, or after the third, the sixth (merged is written, postings is not) or the ninth."""
    data = tmp_path / "in"
    data.mkdir()
    files = lambda: feeds.read_files(spark, str(data))
    put(data, a=A, b=B, bad={"vacancies": [{"company": ""}]})
    stores = {k: StateStore(spark, str(tmp_path / k), buckets=4) for k in ("calm", "stormy")}
    for s in stores.values():
        ingest.run_batch(spark, s, files(), "r1")
    put(data, a={**A, "vacancies": [{**A["vacancies"][0], "tech_stack": ["Kafka"]}]}, bad={"vacancies": [{"role_title": ""}]})
    (data / "b.json").unlink()
    ingest.run_batch(spark, stores["calm"], files(), "r2")
    want = contents(stores["calm"])
    # Adapted once for all: building that plan is most of a small run.
    adapted = feeds.adapt(feeds.check(feeds.envelope(files().filter("source_path = 'a.json'"))))
    for deaths in (0, 3, 6, 9):
        with monkeypatch.context() as m:
            m.setattr(feeds, "adapt", lambda checked, commit=None: adapted)
            dying(m, deaths)
            with pytest.raises(Died):
                ingest.run_batch(spark, stores["stormy"], files(), "r2")
        assert stores["stormy"].snapshot().number == 1
    with monkeypatch.context() as m:
        dying(m, 10)
        ingest.run_batch(spark, stores["stormy"], files(), "r2")
    assert contents(stores["stormy"]) == want
    terms = {r["term"] for r in stores["stormy"].current("postings").collect()}
    assert "kafka" in terms and "python" not in terms and "spark" not in terms
    again = ingest.run_batch(spark, stores["stormy"], files(), "r3").counts
    assert again["unchanged"] == 2 and again["impacted"] == again["quarantined"] == 0 and contents(stores["stormy"]) == want


def test_one_changed_file_rewrites_little(spark, tmp_path):
    text = F.concat(F.lit('{"vacancies": [{"company": "c'), F.col("id"), F.lit('", "role_title": "Engineer '), F.col("id"), F.lit('", "tech_stack": ["Python", "s'), F.col("id"), F.lit('"]}]}'))
    files = spark.range(10_000).select(F.concat(F.lit("f"), F.col("id"), F.lit(".json")).alias("source_path"), F.when(F.col("id") == 77, F.concat(text, F.lit(" "))).otherwise(text).alias("text"))
    hashed = files.withColumn("source_hash", F.sha2("text", 256))
    store = StateStore(spark, str(tmp_path), buckets=512)
    ingest.run_batch(spark, store, hashed, "r1")
    edited = hashed.withColumn("text", F.when(F.col("source_path") == "f4242.json", F.replace("text", F.lit("Python"), F.lit("Kafka"))).otherwise(F.col("text"))).withColumn("source_hash", F.sha2("text", 256))
    sizes = {}
    commit = Transaction.commit

    def measured(self, batch=None):
        sizes.update(self.written_bytes(ingest.TABLES))
        return commit(self, batch)

    Transaction.commit = measured
    try:
        counts = ingest.run_batch(spark, store, edited, "r2").counts
    finally:
        Transaction.commit = commit
    assert (counts["modified"], counts["unchanged"], counts["reindexed"], counts["active"]) == (1, 9999, 1, 10_000)
    assert sum(w for w, _ in sizes.values()) < 0.01 * sum(n for _, n in sizes.values())


def test_document_frequencies_equal_a_recount(spark, tmp_path):
    data, store = tmp_path / "in", StateStore(spark, str(tmp_path / "s"), buckets=4)
    data.mkdir()
    steps = [{"a": A, "b": B}, {"a": {**A, "vacancies": [{**A["vacancies"][0], "tech_stack": ["Kafka", "Spark"]}]}}, {"b": {"vacantes": [{"company": 1}]}}, {"b": None, "c": B}]
    for n, step in enumerate(steps, 1):
        for name, doc in step.items():
            if doc is None:
                (data / f"{name}.json").unlink()
            else:
                put(data, **{name: doc})
        ingest.run_batch(spark, store, feeds.read_files(spark, str(data)), f"r{n}")
        kept = {tuple(r) for r in ingest.frequencies(store.current("frequencies")).collect()}
        assert kept == {tuple(r) for r in lexical.document_frequency(store.current("postings")).collect()}
    run = store.begin()
    run.fold("frequencies", ingest.frequencies, most=1)
    run.commit()
    assert {tuple(r) for r in store.current("frequencies").collect()} == kept and len(store.snapshot().tables["frequencies"].folders) == 1


def test_raw_copies_of_rejected_files(spark, tmp_path):
    data, store = tmp_path / "in", StateStore(spark, str(tmp_path / "s"), buckets=4)
    data.mkdir()
    run = lambda n: ingest.run_batch(spark, store, feeds.read_files(spark, str(data)), f"r{n}")
    copies = lambda: {bytes(r["content"]): r["refs"] for r in store.current("raw").collect()}
    put(data, a=b"{", b=b"{", c=b"\xff", d=A)
    run(1)
    assert copies() == {b"{": 2, b"\xff": 1}
    put(data, b=A)
    (data / "c.json").unlink()
    run(2)
    assert copies() == {b"{": 1, b"\xff": 0}
    ingest.drop_unreferenced(store)
    assert copies() == {b"{": 1}
    put(data, e=b"\xff")
    run(3)
    assert copies() == {b"{": 1, b"\xff": 1}


def test_stream_that_feeds_runs(spark, tmp_path, monkeypatch):
    data, store = tmp_path / "in", StateStore(spark, str(tmp_path / "s"), buckets=4)
    data.mkdir()
    follow = lambda: ingest.follow(spark, store, feeds.named(ingest.file_stream(spark, str(data)), str(data)), str(tmp_path / "cp")).awaitTermination(120)
    put(data, a=A)
    follow()
    put(data, b=B)
    follow()
    follow()
    assert store.snapshot().batches == {"feed": 1} and store.current("merged").count() == 1 and store.current("sources").count() == 2
    before, number = contents(store), store.snapshot().number
    # A batch played again, its run having committed: nothing happens.
    report = ingest.run_batch(spark, store, feeds.read_files(spark, str(data)), "again", partial=True, batch=("feed", 1))
    assert report.status == "replayed" and store.snapshot().number == number and contents(store) == before
    # The files that came are compared with their own entries only: others are not deleted.
    put(data, c={**A, "vacancies": [{**A["vacancies"][0], "company": "Other"}]})
    counts = ingest.run_batch(spark, store, feeds.read_files(spark, str(data), "c.json"), "r", partial=True).counts
    assert (counts["new"], counts["deleted"], counts["active"]) == (1, 0, 2)


def test_evidence_runs(spark, tmp_path, capsys):
    data, state_dir = tmp_path / "md", tmp_path / "state"
    data.mkdir()
    head = "---\nrecord_id: {}\nrecord_type: project\nstatus: canonical\npublic_safe: true\n---\n"
    (data / "a.md").write_text(head.format("a") + "# Spark\nPython and SQL\n[b](b.md)\n")
    (data / "b.md").write_text(head.format("b") + "# Other\nkafka\n")
    store = StateStore(spark, str(state_dir))
    run = lambda n: evidence.run_batch(spark, store, markdown.read_files(spark, str(data)), f"e{n}").counts
    first = run(1)
    assert (first["new"], first["reindexed"], first["records"], first["chunks"], first["relations"]) == (2, 2, 2, 2, 1)
    second = run(2)
    assert (second["unchanged"], second["impacted"], second["reindexed"], second["chunks"]) == (2, 0, 0, 2)
    (data / "b.md").write_text(head.format("b") + "# Other\nflink\n")
    third = run(3)
    assert (third["modified"], third["impacted"], third["reindexed"]) == (1, 1, 1)
    terms = {r["term"] for r in store.current("evidence_postings").collect()}
    assert "flink" in terms and "kafka" not in terms and "python" in terms
    feed = tmp_path / "in"
    feed.mkdir()
    put(feed, a=A)
    assert cli.main(["ingest", str(feed), str(state_dir), "--run-id", "r1"], spark) == 0
    assert cli.main(["evidence", str(data), str(state_dir), "--run-id", "e6"], spark) == 0
    capsys.readouterr()
    assert cli.main(["match", str(state_dir)], spark) == 0
    assert "n_requirements=1" in capsys.readouterr().out
    (data / "c.md").write_text(head.format("a") + "# Twice\nx\n")
    with pytest.raises(ValueError, match="several files"):
        run(4)
    assert store.current("evidence_relations").count() == 1  # the state stays as it was


def test_links_are_resolved_by_what_changed(spark, tmp_path):
    """After adds, deletes and renames the relations are those drawn from all records; a run that dies changes nothing."""
    data, store = tmp_path / "md", StateStore(spark, str(tmp_path / "state"), buckets=4)
    (data / "x").mkdir(parents=True)

    def page(name, record, *links):
        body = f"---\nrecord_id: {record}\nrecord_type: project\nstatus: canonical\npublic_safe: true\n---\n# T {record} ACH-{record.upper()}-1\n"
        (data / name).write_text(body + "".join(f"[l]({x})\n" for x in links))

    def check(n, want):
        counts = evidence.run_batch(spark, store, markdown.read_files(spark, str(data)), f"e{n}").counts
        got = {tuple(r) for r in store.current("evidence_relations").collect()}
        assert got == {tuple(r) for r in sections.relations(store.current("evidence_records")).collect()}
        assert {r[2] for r in got if r[:2] == ("a", "links_to")} == want
        kept = {tuple(r) for r in ingest.frequencies(store.current("evidence_frequencies")).collect()}
        assert kept == {tuple(r) for r in lexical.document_frequency(store.current("evidence_postings")).collect()}
        return counts

    page("a.md", "a", "b.md", "x/c.md", "x/missing.md")
    page("b.md", "b", "a.md")
    assert check(1, {"b"})["relations"] == 4
    page("x/c.md", "c", "../a.md")  # a file that a link waited for
    assert check(2, {"b", "c"})["reindexed"] == 1
    (data / "b.md").unlink()
    assert check(3, {"c"})["deleted"] == 1
    (data / "x/c.md").rename(data / "x/missing.md")  # another path, the same record
    check(4, {"c"})
    page("b.md", "z")  # another record at a path that was linked to
    check(5, {"c", "z"})
    page("b.md", "y")
    check(6, {"c", "y"})
    page("a.md", "a")
    check(7, set())

"""Question pairs, benchmarks, stored files, settings and reports."""

import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestack import stages
from lodestack.operators import build, chunks, evaluate, evidence, models, pairs, report, retrieval
from lodestack.sources import contracts, files, settings
from test_operators import Letters, Overlap

EVIDENCE = "At least 5 years maintaining Python APIs on AWS."
HIGH, LOW = "Which saved role requires at least 5 years maintaining Python APIs on AWS?", "Which saved role requires at least 5 years of work on a public cloud platform?"
JOB = {"id": "j1", "company": "Acme Analytics GmbH", "title": "Senior Data Engineer II, Berlin", "url": "https://jobs.example.org/42", "source_job_id": "gh-42"}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []), ({"low_query": LOW[:-1] + " like AWS?"}, ["low_repeats_anchor"]), ({"low_query": LOW.replace("5 ", "some ")}, ["low_drops_numeric_constraint:5"]), ({"high_query": HIGH[:-1]}, ["high_not_question"]),
        ({"low_query": HIGH}, ["identical_questions", "low_repeats_anchor", "low_not_lower_lexical_overlap"]), ({"anchor_term": None}, ["missing_or_non_string_query_or_anchor"]), ({"anchor_term": "Azure"}, ["anchor_absent_or_invalid", "high_missing_anchor"]),
        ({"high_query": HIGH[:-1] + " at acme?"}, ["high_leaks_company"]), ({"high_query": HIGH[:-1] + " as data engineer?"}, ["high_leaks_title"]), ({"high_query": HIGH[:-1] + " (jobs.example.org)?"}, ["high_leaks_url"]),
        ({"high_query": HIGH[:-1] + " gh-42?"}, ["high_leaks_source_job_id"]), ({"high_query": f"Which role says {EVIDENCE}?"}, ["high_copies_whole_evidence"]), ({"low_query": "5 AWSs?"}, ["query_length"]),
    ],
)
def test_pair_errors(spark, change, want):
    pair = {"high_query": HIGH, "low_query": LOW, "anchor_term": "AWS"} | change
    assert pairs.pair_errors(pair, EVIDENCE, JOB) == want
    df = spark.createDataFrame([(pair["high_query"], pair["low_query"], pair["anchor_term"], EVIDENCE)], "h string, l string, a string, e string")
    assert df.select(pairs.pair_error_column(F.col("h"), F.col("l"), F.col("a"), F.col("e"), {k: F.lit(v) for k, v in JOB.items()})).first()[0] == want


def test_expressions_say_what_the_loop_says(spark):
    """Pairs, evidence and sources of all kinds of parts, checked both ways."""
    rng = random.Random(9)
    bits = ["5", "3.5", "1,700", "Python", "STRASSE", "straße", "ΣΊΣΥΦΟΣ", "σίσυφος", "AWS", "aws?", "c++", "C#", "acme", "Analytics", "the", "data engineer", "Data Engineer II", "jobs.example.org", "www.x.y", "https://jobs.example.org/42", "a.b/c", "gh-42", "j1", "é", " ", "\t", "\u2003", "日本", "İstanbul", "node.js", "?", "(", "\\E", ".", "Müller"]
    text = lambda n: None if rng.random() < 0.03 else " ".join(rng.choices(bits, k=rng.randrange(0, n))) + rng.choice(["", "?", "? ", ".", " ?"])
    urls = ["https://jobs.example.org/42", "http://u:p@Jobs.Example.org:80/x?y", "//host.z", "no url", "", None, "https://[::1]:80/x", "mailto:x@y.z"]
    titles = ["Senior Data Engineer II, Berlin", "sr. Principal AWS", "Lead  Staff Python III", "data engineer", "the", "", None, "Mid-level Müller V", "Senior"]
    companies = ["Acme Analytics GmbH", "The AWS Company", "Müller", "a", "", None, "Example.org-jobs Inc"]
    rows = [(k, text(9), text(9), rng.choice([*bits, "aws c++ the", "a b c d", None]), text(12), rng.choice(companies), rng.choice(titles), rng.choice(["j1", "", None]), rng.choice(["gh-42", "c++", None]), rng.choice(urls)) for k in range(1500)]
    names = ["company", "title", "id", "source_job_id", "url"]
    df = spark.createDataFrame(rows, "k long, h string, l string, a string, e string, " + ", ".join(f"{n} string" for n in names))
    got = dict(df.select("k", pairs.pair_error_column(F.col("h"), F.col("l"), F.col("a"), F.col("e"), {n: F.col(n) for n in names})).collect())
    for k, h, w, a, e, *job in rows:
        want = pairs.pair_errors({"high_query": h, "low_query": w, "anchor_term": a}, e or "", dict(zip(names, job, strict=True)))
        assert got[k] == want, (h, w, a, e, job)


class Scripted:
    """Anchors on a word of the evidence. Its first answer about some evidence cannot be read; of some it accepts none."""

    name, revision = "scripted", "1"

    def generate_pair(self, evidence_text, *, rejection_reason=None):
        if rejection_reason is None and "odd" in evidence_text:
            raise ValueError("no JSON")
        word = evidence_text.split()[1]
        return {"high_query": f"Which role asks to {' '.join(evidence_text.lower().split()[:-2])}?", "low_query": f"Which role asks for skill in number {evidence_text.split()[2]} of things?", "anchor_term": word}

    def validate_pair(self, evidence_text, high_query, low_query, anchor_term):
        return dict.fromkeys(pairs.FLAGS, "never" not in evidence_text) | {"reason": "as told"}


FAMILIES = ("fa", "fb")


@pytest.fixture(scope="module")
def built(spark):
    rows = []
    for k in range(14):
        facts = [f"operate{k} kafka{k} {k + 2} clusters with strict latency goals for payments traffic{' never' if k % 4 == 3 else ''}{' odd' if k % 3 == 0 else ''} here", f"Tune{k} engine{k} {k + 9} for archives in distant places and for many other needs"]
        rows.append((f"j{k:02d}", FAMILIES[k % 2], "Acme Ltd", "Some Role", f"https://x.org/{k}", f"g{k}", "Requirements:\n- " + "\n- ".join(facts)))
    jobs = spark.createDataFrame(rows, "id string, job_family string, company string, title string, url string, source_job_id string, description_clean string")
    nodes = retrieval.written(chunks.passages(jobs, "id", "description_clean", settings.load_heading_types(), keep=["job_family", "company", "title"]).withColumnRenamed("id", "job_id"), "nodes")
    candidates = retrieval.written(evidence.evidence_candidates(jobs, evidence.evidence_rows(jobs, nodes)), "candidates")
    made = build.build_benchmark(jobs, nodes, candidates, Scripted, retrieval.written, build.Quotas(per_family=3, candidates_per_job=2), 7, FAMILIES, "scripted", "1", "p1", "v1")
    return jobs, nodes, candidates, {k: retrieval.written(v, k) if k != "counts" else v for k, v in made.items()}


def serial(built, per_family=3, most=2, attempts=2):
    """The same benchmark, one source after another."""
    import hashlib

    jobs, _, candidates, _ = built
    key = lambda v: hashlib.sha256(f"7\x1f{v}".encode()).hexdigest()
    options = {}
    for c in candidates.collect():
        options.setdefault(c["source_job_id"], []).append(c)
    accepted, rejected = [], []
    for family in FAMILIES:
        taken = 0
        for job in sorted((j for j in jobs.collect() if j["job_family"] == family), key=lambda j: (key(j["id"]), j["id"])):
            if taken == per_family:
                break
            for c in sorted(options.get(job["id"], []), key=lambda c: (-c["distinctiveness_score"], key(c["candidate_id"])))[:most]:
                pair, errors = build.ask(Scripted(), c["evidence_text"], job.asDict(), attempts)
                rejected += [(c["candidate_id"], e["attempt"], tuple(e["reasons"])) for e in errors]
                if pair:
                    accepted.append((family, job["id"], c["candidate_id"], pair["high_query"]))
                    taken += 1
                    break
    return accepted, rejected


def test_benchmark_equals_a_serial_run(built):
    accepted, rejected = serial(built)
    jobs, nodes, candidates, made = built
    queries = made["queries"].orderBy("query_id").collect()
    assert made["counts"]["accepted_pairs"] == len(accepted) == len(queries) // 2 and rejected
    by_pair = [(q["source_job_family"], q["source_job_id"], q["query"]) for q in queries if q["query_type"] == evaluate.KINDS[0]]
    assert by_pair == [(f, j, h) for f, j, _, h in accepted]
    got = sorted((r["candidate_id"], r["attempt"], tuple(r["reasons"])) for r in made["rejections"].collect())
    assert got == sorted(rejected)
    assert pairs.benchmark_errors(jobs, nodes, made["queries"], made["qrels"], 6, 3, FAMILIES).collect() == []
    build.require_complete(made["queries"], 3, FAMILIES)
    with pytest.raises(ValueError, match="expected_4"):
        build.require_complete(made["queries"], 4, FAMILIES)


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda q, r: (q.where("query_id <> 'pair_001_low'"), r), "not_one_of_each_kind"), (lambda q, r: (q.union(q.limit(1)), r), "duplicate_key"), (lambda q, r: (q, r.where("query_id <> 'pair_001_low'")), "no_qrel"),
        (lambda q, r: (q.withColumn("evidence_start", F.col("evidence_start") + 1), r), "not_once_at_place"), (lambda q, r: (q.withColumn("evidence_end", F.col("evidence_end") + 10_000), r), "invalid_place"),
        (lambda q, r: (q.withColumn("evidence_node_ids", F.array(F.lit("x"))), r), "gold_differs"), (lambda q, r: (q, r.withColumn("source_job_id", F.lit("x"))), "source_differs"),
        (lambda q, r: (q.withColumn("source_job_id", F.lit("j00")), r), "chosen_twice"), (lambda q, r: (q.withColumn("validation_status", F.lit("no")), r), "not_passed"),
        (lambda q, r: (q.withColumn("semantic_validation", F.lit(None).cast(q.schema["semantic_validation"].dataType)), r), "semantic"),
        (lambda q, r: (q.withColumn("query", F.lit(" ")), r), "empty_question"), (lambda q, r: (q.withColumn("source_job_family", F.when(F.col("query_type") == evaluate.KINDS[1], "z").otherwise("fa")), r), "sides_differ_source_job_family"),
    ],
)
def test_benchmark_faults_are_found(built, change, error):
    jobs, nodes, _, made = built
    found = pairs.benchmark_errors(jobs, nodes, *change(made["queries"], made["qrels"]))
    assert error in {r["error"] for r in found.collect()}
    with pytest.raises(ValueError):
        pairs.require_valid(jobs, nodes, *change(made["queries"], made["qrels"]))


def test_unknown_sources_are_refused(built):
    jobs, nodes, candidates, _ = built
    with pytest.raises(ValueError, match="unknown_source"):
        build.build_benchmark(jobs.where("id <> 'j00'"), nodes, candidates, Scripted, retrieval.written, build.Quotas(1), 7, FAMILIES)


def test_reports(spark, built, tmp_path):
    jobs, nodes, _, made = built
    queries, qrels = made["queries"], made["qrels"]
    more = [(f"x{k}", "z", "fa", "C", "T", None, "unsectioned", 0, 0, 5, "words", f"words{k}") for k in range(12)]
    nodes = nodes.select(*(c.split()[0] for c in contracts.NODES.split(", "))).union(spark.createDataFrame(more, contracts.NODES))
    results = retrieval.written(retrieval.run_retrieval(nodes, queries, Letters, "run-1", "hash"), "results")
    outcomes = evaluate.outcomes_of(evaluate.evaluate_results(results, qrels, queries))
    tables = evaluate.summarize_pairs(outcomes, evaluate.hashed_draws(spark, 6, 100), 100)
    paths = report.write_reports(tables, results, queries, qrels, nodes, tmp_path / "out", 100, seed=0, most=2)
    assert set(paths) == {*report.FILES, "per_query_scores", "failure_cases", "summary", "analysis"} and all(p.exists() for p in paths.values())
    assert paths["main_table"].read_text().splitlines()[0] == "method,pair_count,high_source_evidence_hit_at_5,low_source_evidence_hit_at_5,hit_drop,high_source_evidence_mrr_at_5,low_source_evidence_mrr_at_5,mrr_drop"
    shown = json.loads(paths["analysis"].read_text())
    assert len(shown["bootstrap_intervals"]) == 18 and shown["pair_count"] == 6 and len(shown["failure_cases"]) <= 2
    assert len(paths["per_query_scores"].read_text().splitlines()) == 36
    reranked = retrieval.written(retrieval.rerank_queries(results, queries, nodes, Overlap, "run-2", "hash"), "reranked")
    again = evaluate.analyze_reranked(results, reranked, queries, qrels, evaluate.hashed_draws(spark, 6, 100), 100)
    made_paths = report.write_rerank_report(again, tmp_path / "rerank", 100)
    assert len(made_paths["paired_differences"].read_text().splitlines()) == 19 and "rerank_bm25_dense" in made_paths["summary"].read_text()
    with pytest.raises(FileExistsError):
        report.write_rerank_report(again, tmp_path / "rerank", 100)
    with pytest.raises(ValueError, match="other pairs"):
        report.write_reports(tables | {"pair_outcomes": outcomes.limit(3)}, results, queries, qrels, nodes, tmp_path / "no", 100)


def test_rows_of_files_are_written_by_tasks(spark, tmp_path):
    """The same bytes as the whole table on the driver gives."""
    rng = random.Random(3)
    rows = [(f"p{k // 2}", ("bm25", "dense")[k % 2], rng.choice([None, 'f"x', "g,h", "é"]), k, rng.random(), None) for k in range(500)]
    table = spark.createDataFrame(rows, "pair string, method string, family string, hit_drop long, rr_drop double, high_query string").repartition(7)
    ordered, shown = report._named("pair_outcomes", table, {"confidence": 0.95})
    whole = [shown(r.asDict()) for r in ordered.collect()]
    columns = ("pair_id", "source_job_family", "hit_drop", "mrr_drop")
    want = files.write_csv(tmp_path / "want.csv", whole, columns)
    header = report._csv_row(columns, dict(zip(columns, columns, strict=True))) + "\n"
    got = files.write_lines(report._rendered(ordered, lambda r: report._csv_row(columns, shown(r))), tmp_path / "got.csv", header)
    assert got.read_bytes() == want.read_bytes()
    for rows in (ordered, ordered.limit(0)):
        whole = [shown(r.asDict()) for r in rows.collect()]
        want = files.write_json(tmp_path / "want.json", {"a": [1], "rows": whole, "z": "é"}, overwrite=True)
        assert report._write_analysis(tmp_path / "got.json", {"a": [1], "z": "é"}, "rows", rows, shown).read_bytes() == want.read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["got.csv", "got.json", "want.csv", "want.json"]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [(2, "b")], "é")], "z long, a string, m array<struct<y:long,x:string>>, t string")
    path = files.write_jsonl(df.coalesce(1), str(tmp_path / "rows"))
    line = next(Path(path).glob("part-*")).read_text()
    assert line == '{"a":null,"m":[{"x":"b","y":2}],"t":"é","z":1}\n'
    assert files.read_jsonl(spark, path, df.schema).collect() == df.collect()
    with pytest.raises(FileExistsError):
        files.write_jsonl(df, path)
    files.write_jsonl(df, path, overwrite=True)
    for bad in ("[1]\n", '"x"\n', '{"z": "no"}\n', "{\n"):
        (tmp_path / "bad.jsonl").write_text('{"z": 1}\n\n' + bad)
        with pytest.raises(Exception):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "z long").collect()


def test_small_files(tmp_path):
    path = files.write_json(tmp_path / "a" / "x.json", {"b": 1, "a": "é"})
    assert path.read_text() == '{\n  "a": "é",\n  "b": 1\n}\n' and files.file_sha256(path) == __import__("hashlib").sha256(path.read_bytes()).hexdigest()
    with pytest.raises(FileExistsError):
        files.write_json(path, {})
    files.write_json(path, {}, overwrite=True)
    assert [p.name for p in path.parent.iterdir()] == ["x.json"]
    assert files.object_sha256({"b": [1, "é"], "a": None}) == __import__("hashlib").sha256('{"a":null,"b":[1,"é"]}'.encode()).hexdigest()
    table = files.write_csv(tmp_path / "t.csv", [{"a": 1, "b": 'x"y', "c": 2}], ["b", "a"])
    assert table.read_bytes() == b'b,a\r\n"x""y",1\r\n'
    with pytest.raises(ValueError):
        files.write_csv(tmp_path / "t.csv", [{"a": 1, "c": 2}], ["a"], extra="raise")
    copies = files.copy_frozen({"x.json": path}, tmp_path / "copy")
    files.copy_frozen({"x.json": path}, tmp_path / "copy")
    copies["x.json"].write_text("other")
    with pytest.raises(ValueError, match="differs"):
        files.copy_frozen({"x.json": path}, tmp_path / "copy")
    model = tmp_path / "snapshots" / "r1"
    (model / "onnx").mkdir(parents=True)
    (model / "w.bin").write_bytes(b"1"), (model / "onnx" / "x.bin").write_bytes(b"2")
    mark = files.model_fingerprint(model, "r1")
    assert list(mark["files"]) == ["w.bin"] and mark["hub_snapshot_path_matches_revision"] and files.model_folder({"local_path": str(model)}) == model
    with pytest.raises(FileNotFoundError):
        files.model_folder({"model_id": "a/b", "revision": "r"}, tmp_path)
    assert files.installed_versions(["pyspark", "no-such"])["no-such"] is None


def test_settings(tmp_path):
    def load(kind, value):
        (tmp_path / "x.yaml").write_text(json.dumps(value))
        return kind(tmp_path / "x.yaml")

    board = {"company": "A", "provider": "lever", "board_slug": "a"}
    assert load(settings.load_sources, {"sources": [board]}).sources[0].priority_group == "global"
    for bad in ([], {"sources": []}, {"sources": [board, board]}, {"sources": [board | {"provider": "x"}]}, {"sources": [board | {"more": 1}]}, {"sources": [{"company": "A"}]}, {"discovery": {"domains": {}}}, {"discovery": {"domains": {"lever": ["x"]}, "max_boards_per_run": 1, "min_boards_before_stop": 2}}):
        with pytest.raises(settings.SettingsError):
            load(settings.load_sources, bad)
    assert load(settings.load_sources, {"discovery": {"domains": {"lever": ["x"]}}}).discovery.index_pages_per_domain == 3
    rules = settings.load_yaml(settings.CONFIG / "title_rules.yaml")
    for bad in (rules | {"families": {}}, rules | {"internship_title_patterns": []}, rules | {"internship_title_patterns": ["("]}, rules | {"extra": ["x"]}):
        with pytest.raises(settings.SettingsError):
            load(settings.load_title_rules, bad)
    assert load(settings.load_sampling, {"target_per_family": 60, "sampling_seed": "s"}).max_jobs_per_company == 4
    for bad in ({"target_per_family": 101, "sampling_seed": "s"}, {"target_per_family": 1, "sampling_seed": " "}, {"target_per_family": True, "sampling_seed": "s"}):
        with pytest.raises(settings.SettingsError):
            load(settings.load_sampling, bad)
    assert len(settings.load_heading_types()) == 8
    for bad in ({"sections": {}}, {"sections": {"a": {"label": "A", "patterns": []}}}, {"sections": {"a": {"patterns": ["x"]}}}):
        with pytest.raises(settings.SettingsError):
            load(settings.load_heading_types, bad)


RUN = {
    "experiment_version": "jd_v2", "seed": 1, "chunk": {"chunk_size": 1000}, "evidence": {}, "benchmark": {"per_family": 20, "prompt_version": "jd_v2_generation_2"},
    "models": {"dense": {"model_id": "m", "revision": "r", "normalize": True, "pooling_method": "cls", "similarity": "cosine"}, "generator": {"model_id": "g", "revision": "r", "local_path": "/x", "do_sample": False, "enable_thinking": False, "device_map": "auto"}},
    "retrieval": {"top_k": 20, "rrf_k": 60, "tokenizer": "technical_terms_v1", "lowercase": True, "stemming": False, "stopwords": "none"}, "evaluation": {"top_k": 5},
}


def test_run_settings(tmp_path):
    settings.check_retrieval_settings(RUN)
    for part, key, value in (("retrieval", "rrf_k", 61), ("evaluation", "top_k", 10), ("benchmark", "per_family", 2), ("retrieval", "lowercase", 1)):
        with pytest.raises(settings.SettingsError):
            settings.check_retrieval_settings(RUN | {part: RUN[part] | {key: value}})
    rerank = {
        "experiment_version": "jd_v3_rerank_1", "run_id": "r1", "candidate": {"methods": ["bm25", "dense"], "top_k_per_method": 20, "deduplicate_by": "node_id"}, "evaluation": {"top_k": 5},
        "reranker": {"model_id": "BAAI/bge-reranker-v2-m3", "revision": "a" * 40, "normalize": False, "batch_size": 16, "max_length": 1024},
        "source": {"benchmark_dir": "b", "run_dir": "runs/x"}, "paths": {"benchmark_snapshot_dir": "b3", "runs_dir": "runs3", "reports_dir": "rep"},
    }
    settings.check_rerank_settings(rerank, tmp_path)
    for bad in ({"run_id": "../x"}, {"paths": rerank["paths"] | {"runs_dir": "b"}}, {"paths": rerank["paths"] | {"reports_dir": "runs3"}}, {"reranker": rerank["reranker"] | {"revision": "main"}}):
        with pytest.raises(settings.SettingsError):
            settings.check_rerank_settings(rerank | bad, tmp_path)
    rules = settings.CONFIG / "section_headings.yaml"
    manifest = contracts.base_manifest(RUN, "c", "n", 3, rules)
    assert "local_path" not in manifest["generator_model"] and contracts.settings_errors(RUN, manifest, rules) == []
    assert contracts.settings_errors(RUN | {"seed": 2}, manifest, rules) == ["seed"]


def test_stored_run_is_held_to_its_manifests(spark, built, tmp_path):
    jobs, nodes, _, made = built
    more = spark.createDataFrame([(f"x{k}", "z", "fa", "C", "T", None, "unsectioned", 0, 0, 5, "words", f"words{k}") for k in range(12)], contracts.NODES)
    nodes = nodes.select(*(c.split()[0] for c in contracts.NODES.split(", "))).union(more)
    results = retrieval.run_retrieval(nodes, made["queries"], Letters, "run-1", "hash")
    bench, run = tmp_path / "bench", tmp_path / "run-1"
    bench.mkdir(), run.mkdir()

    def one_file(df, path):
        files.write_jsonl(df.coalesce(1), str(tmp_path / "parts"), overwrite=True)
        shutil.copy(next((tmp_path / "parts").glob("part-*")), path)
        return files.file_sha256(path)

    digests = {f"{n}_sha256": one_file(t, bench / f"{n}.jsonl") for n, t in (("nodes", nodes), ("queries", made["queries"]), ("qrels", made["qrels"]))}
    n = made["queries"].count()
    files.write_json(bench / "manifest.json", digests | {"benchmark_version": "jd_v2", "frozen": True, "dataset_sha256": "d", "node_count": nodes.count(), "query_count": n, "pair_count": n // 2})
    found = one_file(results, run / "retrieval_results.jsonl")
    config = RUN | {"x": 1}
    whole = contracts.run_manifest(spark, "run-1", config, contracts.read_manifest(bench), bench / "manifest.json", run / "retrieval_results.jsonl", 3 * n, {})
    assert whole["retrieval_results_sha256"] == found
    files.write_json(run / "manifest.json", whole | {"config_sha256": "hash"})
    loaded = contracts.load_run(spark, bench, run)
    assert loaded["results"].count() == 3 * n
    queries, qrels = contracts.load_frozen(spark, bench, jobs, nodes.where("job_id <> 'z'"), contracts.read_manifest(bench), 3, FAMILIES)
    assert queries.count() == n and qrels.count() == n
    with pytest.raises(ValueError, match="digest"):
        contracts.load_nodes(spark, str(bench / "nodes.jsonl"), {"nodes_sha256": "no"})
    assert contracts.load_nodes(spark, str(bench / "nodes.jsonl"), contracts.read_manifest(bench)).count() == nodes.count()
    (bench / "qrels.jsonl").write_text("")
    with pytest.raises(ValueError, match="digest"):
        contracts.load_run(spark, bench, run)


class Talker:
    """Answers as a model would: fenced JSON; the first answer about a source is no JSON."""

    def __call__(self, instructions, content):
        given = json.loads(content)
        if "high_query" in given:
            return "```json\n" + json.dumps(dict.fromkeys(pairs.FLAGS, True) | {"reason": "fine"}) + "\n```"
        words = given["evidence"].split()
        if "last_attempt_failed" not in given and words[0].endswith("3"):
            return "I think that"
        return "```" + json.dumps({"high_query": f"Which role asks to {' '.join(words[:-2])}?", "low_query": f"Which role wants {words[2]} of some other thing entirely?", "anchor_term": words[1]}) + "```"


def talker():
    return models.JsonGenerator(Talker(), "talker", "1")


def test_answers_of_models():
    assert models.read_answer(' {"a": 1} ') == models.read_answer('```json {"a": 1}```') == models.read_answer('```\n{"a": 1}\n```') == {"a": 1}
    for bad in ("", "[1]", "no", "```json```"):
        with pytest.raises(ValueError):
            models.read_answer(bad)
    models.check_scorer(type("Bare", (), {"compute_score": lambda self, p: Overlap().compute_score([(q.replace("?", ""), t.replace(".", "")) for q, t in p])})())
    with pytest.raises(ValueError):
        models.check_scorer(type("Flat", (), {"compute_score": lambda self, p: [1.0, 1.0]})())
    with pytest.raises(ValueError):
        models.check_embedder(type("Zero", (), {"encode": lambda self, t: [[0.0]] * 3})())
    models.check_embedder(type("Words", (), {"encode": lambda self, t: [[1.0, x.count("of") + x.count("years")] for x in t]})())
    with pytest.raises(ValueError, match="no pair"):
        models.check_generator(models.JsonGenerator(lambda i, c: "{}", "none"))
    assert models.loaded("json:dumps") is json.dumps


def test_stages_from_corpus_to_report(spark, tmp_path):
    rows = []
    for k in range(8):
        facts = [f"operate{k} kafka{k} {k + 2} clusters with strict latency goals for payments traffic in several places here", f"maintain{k} engine{k} {k + 9} for archives in distant places and for many other needs"]
        rows.append({"id": f"j{k}", "job_family": settings.FAMILIES[k % 4], "company": "Acme Ltd", "title": "Some Role", "url": f"https://x.org/{k}", "source_job_id": f"g{k}", "description_clean": "Requirements:\n- " + "\n- ".join(facts) + "\nFiller " * 30})
    (tmp_path / "jobs.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    config = {
        "experiment_version": "jd_v2", "dataset_sha256": files.file_sha256(tmp_path / "jobs.jsonl"), "corpus_per_family": 2, "seed": 3,
        "paths": {"corpus": "jobs.jsonl", "benchmark_dir": "bench", "runs_dir": "runs", "report_dir": "reports"},
        "chunk": {"chunk_size": 120, "chunk_overlap": 20, "heading_config": str(settings.CONFIG / "section_headings.yaml"), "include_heading_in_retrieval": True},
        "evidence": {"min_chars": 40, "max_chars": 420, "min_words": 8, "max_words": 70, "max_document_frequency": 0.35},
        "benchmark": {"per_family": 1, "max_attempts_per_candidate": 3, "max_candidates_per_job": 8, "review_sample_size": 2, "prompt_version": "p"},
        "models": RUN["models"], "retrieval": RUN["retrieval"] | {"bm25_k1": 1.5, "bm25_b": 0.75}, "evaluation": {"top_k": 5, "bootstrap_samples": 100, "bootstrap_confidence": 0.95, "failure_case_limit": 3},
    }
    x = stages.Experiment(spark, config, tmp_path)
    made = stages.prepare(x)
    assert made["node_count"] >= 20 and stages.prepare(x) == made
    with pytest.raises(settings.SettingsError, match="prepared with"):
        stages.benchmark(stages.Experiment(spark, config | {"seed": 4}, tmp_path), talker)
    frozen = stages.benchmark(x, talker)
    assert frozen["pair_count"] == 4 and stages.benchmark(x, talker) == frozen and stages.validate(x) == (made["node_count"], 8)
    assert len({json.loads(line)["pair_id"] for p in (tmp_path / "bench" / "review_sample.jsonl").glob("part-*") for line in p.read_text().splitlines()}) == 2
    folder = stages.retrieve(x, Letters, "run-1")
    with pytest.raises(settings.SettingsError, match="exists"):
        stages.retrieve(x, Letters, "run-1")
    paths = stages.make_report(x, "run-1")
    assert "report_files" in json.loads((folder / "manifest.json").read_text()) and len(json.loads(paths["analysis"].read_text())["main_table"]) == 3
    rerank = {
        "experiment_version": "jd_v3_rerank_1", "run_id": "again", "candidate": {"methods": ["bm25", "dense"], "top_k_per_method": 20, "deduplicate_by": "node_id"}, "evaluation": {"top_k": 5, "bootstrap_samples": 100, "bootstrap_confidence": 0.95, "seed": 3},
        "reranker": {"model_id": "BAAI/bge-reranker-v2-m3", "revision": "a" * 40, "normalize": False, "batch_size": 16, "max_length": 1024}, "source": {"benchmark_dir": "bench", "run_dir": "runs/run-1"},
        "paths": {"benchmark_snapshot_dir": "copy", "runs_dir": "reranked", "reports_dir": "reports2"},
    }
    again = stages.rerank(spark, settings.check_rerank_settings(rerank, tmp_path), Overlap, tmp_path)
    about = json.loads((again / "manifest.json").read_text())
    assert about["result_row_count"] == 8 and set(about["input_snapshot"]) == {"source_manifest.json", "nodes.jsonl", "queries.jsonl", "qrels.jsonl"}
    next((tmp_path / "bench" / "qrels.jsonl").glob("part-*")).write_text("")
    with pytest.raises(settings.SettingsError, match="digest"):
        stages.make_report(x, "run-1")
    with pytest.raises(SystemExit):
        stages.main(["report"])


def test_corpus_contract(spark, tmp_path):
    rows = [(f"j{k}", "fa", "text") for k in range(3)]
    good = spark.createDataFrame(rows, "id string, job_family string, description_clean string")
    assert contracts.corpus_errors(good, 3, ("fa",)).count() == 0
    bad = good.union(spark.createDataFrame([("j0", "fa", " "), (None, "zz", "x")], good.schema))
    assert {r["error"] for r in contracts.corpus_errors(bad, 3, ("fa", "fb")).collect()} == {"duplicate_key", "empty_key", "empty_text", "expected_3_found_4", "expected_3_found_1", "expected_3_found_0"}


def test_everything_but_llm_works_without_it(tmp_path):
    """A copy of the tree without the llm folders still loads, and gives its queries."""
    root = Path(__file__).resolve().parent.parent
    for also in ((), ("corpus_pipeline.py",)):
        copy = tmp_path / f"copy{len(also)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); import bench"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={"PATH": "/usr/bin:/bin"})

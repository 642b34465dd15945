"""The stages of an experiment, from a corpus to a report, each from files to files.

``python -m lodestack.stages STAGE --config FILE`` runs prepare, benchmark, validate,
retrieve, report, rerank or one of the model checks. Tables are folders of JSON lines;
digests in manifests chain the stages, and a stage that finds other inputs than those it
was made for stops. Models are named as ``module:factory``."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import build, evaluate, evidence, models, pairs, report, retrieval
from lodestack.operators.chunks import passages
from lodestack.sources import contracts, files, settings
from lodestack.sources.digests import lines_digest
from lodestack.storage import written

NODE_ORDER = ("job_id", "start_offset")


class Experiment:
    """Settings, and the paths that they name below ``root``."""

    def __init__(self, spark: SparkSession, config: Mapping[str, Any], root: str | Path = "."):
        self.spark, self.config, self.root = spark, config, Path(root)
        self.bench = self.path(config["paths"]["benchmark_dir"])
        self.rules = self.path(config["chunk"]["heading_config"])
        self.digest = files.object_sha256(config)

    def path(self, value: str) -> Path:
        return self.root / Path(value).expanduser()

    def corpus(self) -> DataFrame:
        summary = self.path(self.config["paths"].get("dataset_summary", "-"))
        if summary.exists():
            settings.need(settings.load_yaml(summary).get("dataset_sha256") == self.config["dataset_sha256"], "the corpus summary is of another corpus")
        return contracts.load_corpus(self.spark, str(self.path(self.config["paths"]["corpus"])), self.config["dataset_sha256"], self.config.get("corpus_per_family", 60))

    def manifest(self) -> dict[str, Any]:
        found = contracts.read_manifest(self.bench)
        settings.need(found.get("dataset_sha256") == self.config["dataset_sha256"], "the benchmark is of another corpus")
        wrong = contracts.settings_errors(self.config, found, self.rules)
        settings.need(not wrong, f"settings are not those that the benchmark was prepared with: {wrong}")
        return found

    def nodes(self, manifest: Mapping[str, Any]) -> DataFrame:
        return contracts.load_nodes(self.spark, str(self.bench / "nodes.jsonl"), manifest)

    def frozen(self, jobs: DataFrame, nodes: DataFrame, manifest: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        return contracts.load_frozen(self.spark, self.bench, jobs, nodes, manifest, self.config["benchmark"]["per_family"])


def _kept(df: DataFrame, path: Path, schema: str) -> None:
    """Writes a table, or holds it to the one that is there."""
    if not path.exists():
        files.write_jsonl(df, str(path))
        return
    old, new = files.read_jsonl(df.sparkSession, str(path), schema).select(*df.columns), df
    settings.need(not old.exceptAll(new).limit(1).count() and not new.exceptAll(old).limit(1).count(), f"{path} holds other rows")


def prepare(x: Experiment) -> dict[str, Any]:
    """Passages of the corpus, and a manifest of what they were made of."""
    jobs, chunk = x.corpus(), x.config["chunk"]
    keep = ("job_family", "company", "title")
    cut = passages(jobs, "id", "description_clean", settings.load_heading_types(x.rules), chunk["chunk_size"], chunk["chunk_overlap"], keep, chunk["include_heading_in_retrieval"])
    nodes = cut.withColumnRenamed("id", "job_id").orderBy(*NODE_ORDER)
    _kept(nodes, x.bench / "nodes.jsonl", contracts.NODES)
    digest, count = lines_digest(x.spark, str(x.bench / "nodes.jsonl")), files.read_jsonl(x.spark, str(x.bench / "nodes.jsonl"), contracts.NODES).count()
    made = contracts.base_manifest(x.config, x.config["dataset_sha256"], digest, count, x.rules)
    if (x.bench / "manifest.json").exists():
        old = contracts.read_manifest(x.bench)
        settings.need(old.get("dataset_sha256") == made["dataset_sha256"] and old.get("nodes_sha256") == digest, "the manifest is of other passages")
        if old.get("frozen"):
            return x.manifest()
    files.write_json(x.bench / "manifest.json", made, overwrite=True)
    return made


def benchmark(x: Experiment, make_generator: Callable[[], build.PairGenerator], model_files: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """A frozen benchmark: evidence, pairs of questions up to the quota, and what was rejected and why."""
    jobs, manifest, config = x.corpus(), x.manifest(), x.config
    nodes, there = x.nodes(manifest), [(x.bench / f"{n}.jsonl").exists() for n in ("queries", "qrels")]
    if any(there):
        settings.need(all(there) and manifest.get("frozen"), "there are files of an unfinished benchmark")
        x.frozen(jobs, nodes, manifest)
        return manifest
    rows = written(evidence.evidence_rows(jobs, nodes, evidence.Limits(**config["evidence"])), "evidence")
    candidates = evidence.evidence_candidates(jobs, rows)
    _kept(candidates, x.bench / "evidence_candidates.jsonl", candidates.schema)
    files.write_jsonl(evidence.evidence_rejections(rows), str(x.bench / "evidence_rejections.jsonl"), overwrite=True)
    own, model = config["benchmark"], config["models"]["generator"]
    quotas = build.Quotas(own["per_family"], own["max_attempts_per_candidate"], own["max_candidates_per_job"], own["review_sample_size"])
    made = build.build_benchmark(jobs, nodes, written(candidates, "candidates"), make_generator, written, quotas, config["seed"], settings.FAMILIES, model["model_id"], model["revision"], own["prompt_version"], models.JUDGE_VERSION)
    queries = written(made["queries"], "queries")
    counts = {r["outcome"]: r["spans"] for r in evidence.evidence_counts(rows).collect()}
    counts["candidate_spans"] = sum(counts.values())
    complete = made["counts"]["accepted_pairs"] == made["counts"]["target_pairs"]
    files.write_jsonl(made["rejections"], str(x.bench / "benchmark_rejections.jsonl"), overwrite=True)
    files.write_json(x.bench / "selection_audit.json", {"evidence_counts": counts, "benchmark_counts": made["counts"], "complete": complete}, overwrite=True)
    build.require_complete(queries, quotas.per_family)
    qrels = made["qrels"]
    pairs.require_valid(jobs, nodes, queries, qrels, expected_pairs=quotas.per_family * len(settings.FAMILIES), expected_per_family=quotas.per_family, families=settings.FAMILIES)
    files.write_jsonl(build.review_sample(queries, config["seed"], quotas.review_sample), str(x.bench / "review_sample.jsonl"), overwrite=True)
    build.write_benchmark(queries, qrels, x.bench, quotas.per_family)
    digests = {f"{n}_sha256": lines_digest(x.spark, str(x.bench / f"{n}.jsonl")) for n in ("evidence_candidates", "queries", "qrels")}
    n = queries.count()
    manifest |= digests | {"frozen": True, "frozen_at_utc": dt.datetime.now(dt.UTC).isoformat(), "evidence_counts": counts, "benchmark_counts": made["counts"], "generator_snapshot": model_files, "query_count": n, "pair_count": n // 2, "dependencies": files.installed_versions()}
    files.write_json(x.bench / "manifest.json", manifest, overwrite=True)
    return manifest


def validate(x: Experiment) -> tuple[int, int]:
    """(passages, questions) of a frozen benchmark that holds all its rules."""
    jobs, manifest = x.corpus(), x.manifest()
    nodes = x.nodes(manifest)
    return nodes.count(), x.frozen(jobs, nodes, manifest)[0].count()


def _new_run_id(x: Experiment, value: str | None) -> str:
    return settings.run_id(value or f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%SZ}_{x.digest[:8]}")


def retrieve(x: Experiment, make_embedder: Callable[[], Any], run_id: str | None = None, model_files: Mapping[str, Any] | None = None) -> Path:
    """The folder of a new run: rankings of every question by every method, scored once as a check."""
    jobs, manifest, own = x.corpus(), x.manifest(), x.config["retrieval"]
    nodes = x.nodes(manifest)
    queries, qrels = x.frozen(jobs, nodes, manifest)
    folder = x.path(x.config["paths"]["runs_dir"]) / _new_run_id(x, run_id)
    settings.need(not folder.exists(), f"{folder} exists")
    results = written(retrieval.run_retrieval(nodes, queries, make_embedder, folder.name, x.digest, own["top_k"], own["rrf_k"], own["bm25_k1"], own["bm25_b"], x.config["models"]["dense"]["model_id"]), "results")
    evaluate.require_none(pairs.ranking_errors(results, nodes, own["top_k"]))
    evaluate.evaluate_results(results, qrels, queries, x.config["evaluation"]["top_k"])
    path = folder / "retrieval_results.jsonl"
    files.write_jsonl(results.orderBy("query_id", "method"), str(path))
    made = contracts.run_manifest(x.spark, folder.name, x.config, manifest, x.bench / "manifest.json", path, results.count(), model_files or {})
    files.write_json(folder / "manifest.json", made)
    return folder


def _draws(spark: SparkSession, queries: DataFrame, replicates: int, seed: int) -> DataFrame:
    return evaluate.twister_draws(spark, queries.select("pair_id").distinct().count(), replicates, seed)


def make_report(x: Experiment, run_id: str) -> dict[str, Path]:
    """Tables, failure cases and a summary of a run whose inputs and results are still what its manifest says."""
    jobs, manifest, own = x.corpus(), x.manifest(), x.config["evaluation"]
    x.frozen(jobs, x.nodes(manifest), manifest)
    folder = x.path(x.config["paths"]["runs_dir"]) / settings.run_id(run_id)
    run = contracts.load_run(x.spark, x.bench, folder, x.config["retrieval"]["top_k"])
    settings.need(run["run_manifest"]["config_sha256"] == x.digest, "the run was made with other settings")
    scores = evaluate.evaluate_results(run["results"], run["qrels"], run["queries"], own["top_k"])
    outcomes = written(evaluate.outcomes_of(scores), "outcomes")
    draws = _draws(x.spark, run["queries"], own["bootstrap_samples"], x.config["seed"])
    tables = evaluate.summarize_pairs(outcomes, draws, own["bootstrap_samples"], own["bootstrap_confidence"])
    made = report.write_reports(tables, run["results"], run["queries"], run["qrels"], run["nodes"], x.path(x.config["paths"]["report_dir"]) / folder.name, own["bootstrap_samples"], own["bootstrap_confidence"], x.config["seed"], own["failure_case_limit"])
    listed = {name: {"path": str(path), "sha256": files.file_sha256(path)} for name, path in made.items()}
    files.write_json(folder / "manifest.json", run["run_manifest"] | {"report_files": listed, "per_query_scores_sha256": listed["per_query_scores"]["sha256"]}, overwrite=True)
    return made


def rerank(spark: SparkSession, config: Mapping[str, Any], make_scorer: Callable[[], Any], root: str | Path = ".", model_files: Mapping[str, Any] | None = None) -> Path:
    """The folder of a reranking of a finished run's candidates, with its own copy of the inputs and a report."""
    root, name, own = Path(root), settings.run_id(config["run_id"]), config["evaluation"]
    bench, source = root / config["source"]["benchmark_dir"], root / config["source"]["run_dir"]
    folder, shown = root / config["paths"]["runs_dir"] / name, root / config["paths"]["reports_dir"] / name
    settings.need(not folder.exists() and not shown.exists(), f"{name} exists")
    run, digest = contracts.load_run(spark, bench, source, config["candidate"]["top_k_per_method"]), files.object_sha256(config)
    reranked = written(retrieval.rerank_queries(run["results"], run["queries"], run["nodes"], make_scorer, name, digest, config["candidate"]["top_k_per_method"]), "reranked")
    draws = _draws(spark, run["queries"], own["bootstrap_samples"], own["seed"])
    tables = evaluate.analyze_reranked(run["results"], reranked, run["queries"], run["qrels"], draws, own["bootstrap_samples"], own["bootstrap_confidence"])
    copies = files.copy_frozen({"source_manifest.json": bench / "manifest.json"} | {f"{n}.jsonl": bench / f"{n}.jsonl" for n in ("nodes", "queries", "qrels")}, root / config["paths"]["benchmark_snapshot_dir"], spark)
    path = folder / "reranked_results.jsonl"
    files.write_jsonl(reranked.orderBy("query_id"), str(path))
    made = report.write_rerank_report(tables, shown, own["bootstrap_samples"], own["bootstrap_confidence"])
    digests = lambda paths: {n: {"path": str(p), "sha256": files.digest_of(spark, p)} for n, p in paths.items()}
    about = {
        "experiment_version": config["experiment_version"], "run_id": name, "saved_utc": dt.datetime.now(dt.UTC).isoformat(), "config_sha256": digest,
        "source_run_id": run["run_manifest"]["run_id"], "source_manifest_sha256": files.file_sha256(bench / "manifest.json"), "source_run_manifest_sha256": files.file_sha256(source / "manifest.json"),
        "source_results_sha256": files.digest_of(spark, source / "retrieval_results.jsonl"), "source_dataset_sha256": run["benchmark_manifest"].get("dataset_sha256"), "input_snapshot": digests(copies),
        "candidate": config["candidate"], "reranker": settings.model_record(config["reranker"]), "reranker_snapshot": model_files, "evaluation": own, "dependencies": files.installed_versions(),
        "reranked_results_sha256": lines_digest(spark, str(path)), "result_row_count": reranked.count(), "report_files": digests(made),
    }
    files.write_json(folder / "manifest.json", about)
    return folder


STAGES = ("prepare", "benchmark", "validate", "retrieve", "report", "rerank", "check-models")


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Runs one stage of an experiment.")
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--config", required=True)
    parser.add_argument("--root", default=".")
    parser.add_argument("--run-id")
    for name in ("generator", "embedder", "scorer"):
        parser.add_argument(f"--{name}", help="module:factory")
    args = parser.parse_args(argv)
    config = settings.load_yaml(args.config)
    model = lambda name: models.loaded(getattr(args, name) or parser.error(f"--{name} is needed"))
    if args.stage == "check-models":
        for name, check in (("generator", models.check_generator), ("embedder", models.check_embedder), ("scorer", models.check_scorer)):
            if getattr(args, name):
                check(model(name)())
        return
    spark = SparkSession.builder.appName("lodestack").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.stage == "rerank":
        print(rerank(spark, settings.check_rerank_settings(config, args.root), model("scorer"), args.root))
        return
    x = Experiment(spark, settings.check_retrieval_settings(config), args.root)
    if args.stage == "prepare":
        print(prepare(x)["node_count"])
    elif args.stage == "benchmark":
        print(benchmark(x, model("generator"))["pair_count"])
    elif args.stage == "validate":
        print(*validate(x))
    elif args.stage == "retrieve":
        print(retrieve(x, model("embedder"), args.run_id))
    else:
        print(*make_report(x, args.run_id or parser.error("--run-id is needed")).values(), sep="\n")


if __name__ == "__main__":
    main()

"""What stored tables must hold before a stage uses them: counts, keys and digests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.evaluate import evaluate_results, require_none
from lodestack.operators.pairs import duplicates, ranking_errors, require_valid
from lodestack.sources.digests import ROWS, lines_digest
from lodestack.sources.files import digest_of, file_sha256, installed_versions, object_sha256, read_jsonl
from lodestack.sources.settings import FAMILIES, PROVIDERS, model_record, need

#: Schemas of the stored tables.
JOBS = "id string, job_family string, source string, source_job_id string, company string, title string, url string, location string, description_raw string, description_clean string, posted_at timestamp, fetched_at timestamp, workplace_type string, employment_type string, department string, team string, salary_min double, salary_max double, salary_currency string, seniority string, source_metadata map<string,string>"
NODES = "node_id string, job_id string, job_family string, company string, title string, section_heading string, canonical_section string, chunk_index long, start_offset long, end_offset long, content_text string, retrieval_text string"
QUERIES = "query_id string, pair_id string, query_type string, query string, source_job_id string, source_job_family string, evidence_text string, evidence_start long, evidence_end long, evidence_node_ids array<string>, anchor_term string, generator_model string, generator_revision string, prompt_version string, validation_prompt_version string, validation_status string, semantic_validation struct<role_related_atomic_fact:boolean,self_contained_evidence:boolean,same_information_need:boolean,high_supported:boolean,low_supported:boolean,constraints_preserved:boolean,natural_questions:boolean,low_is_conceptual_paraphrase:boolean>"
QRELS = "query_id string, pair_id string, source_job_id string, evidence_node_ids array<string>"
RESULTS = "run_id string, query_id string, method string, ranked_node_ids array<string>, ranked_results array<struct<node_id:string,rank:long,score:double,bm25_rank:long,dense_rank:long>>, config_hash string"


def blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def corpus_errors(jobs: DataFrame, per_family: int = 60, families: Sequence[str] = FAMILIES) -> DataFrame:
    """(scope, key, error): ids that are blank or repeat, blank texts, and families without their number of rows."""
    spark = jobs.sparkSession
    counts = spark.createDataFrame([(f,) for f in families], "job_family string").join(jobs.groupBy("job_family").agg(F.count(F.lit(1)).alias("n")), "job_family", "full_outer")
    wrong = counts.where(~F.coalesce((F.col("n") == per_family) & F.col("job_family").isin(*families), F.lit(False)))
    empty = jobs.where(blank("description_clean")).select(F.lit("job").alias("scope"), F.col("id").alias("key"), F.lit("empty_text").alias("error"))
    sizes = wrong.select(F.lit("family").alias("scope"), F.col("job_family").alias("key"), F.concat(F.lit(f"expected_{per_family}_found_"), F.coalesce("n", F.lit(0)).cast("string")).alias("error"))
    return duplicates(jobs, "job", "id").union(empty).union(sizes)


def record_errors(jobs: DataFrame, classified: bool = True) -> DataFrame:
    """(scope, key, error): records that break the rules of their fields; ``classified`` ones have an id, a family and a clean text."""
    scheme, host = F.try_parse_url(F.col("url"), F.lit("PROTOCOL")), F.try_parse_url(F.col("url"), F.lit("HOST"))
    checks = {f"blank_{n}": blank(n) for n in ("source_job_id", "company", "title", "url")}
    checks |= {
        "unknown_source": ~F.coalesce(F.col("source").isin(*PROVIDERS), F.lit(False)),
        "url_not_http": ~F.coalesce(F.lower(scheme).isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), F.lit(False)),
        "empty_description": F.coalesce("description_raw", F.lit("")) == "",
        "no_fetched_at": F.col("fetched_at").isNull(),
    }
    if classified:
        checks |= {"id_not_hex": ~F.coalesce(F.col("id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "unknown_family": ~F.coalesce(F.col("job_family").isin(*FAMILIES), F.lit(False)), "blank_clean": blank("description_clean")}
    else:
        checks["blank_board"] = blank("board_slug")
    found = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())), lambda e: e.isNotNull())
    return jobs.select(F.lit("job").alias("scope"), F.col("id" if classified else "source_job_id").alias("key"), F.explode(found).alias("error"))


def same_digest(spark: SparkSession, path: str | Path, expected: Any, name: str) -> str:
    """A digest of rows is made by tasks; a plain one, of a file as others pinned it, block by block."""
    found = lines_digest(spark, str(path)) if str(expected).startswith(ROWS) else file_sha256(path)
    need(found == expected, f"{name} has digest {found}, not {expected}")
    return found


def read_manifest(folder: str | Path) -> dict[str, Any]:
    value = json.loads((Path(folder) / "manifest.json").read_text(encoding="utf-8"))
    need(isinstance(value, dict), "a manifest is an object")
    return value


def base_manifest(config: Mapping[str, Any], corpus_digest: str, nodes_digest: str, node_count: int, heading_rules: str | Path) -> dict[str, Any]:
    """What a prepared benchmark was made of and with."""
    kept = {name: config[key] for name, key in {"seed": "seed", "chunk": "chunk", "evidence_config": "evidence", "benchmark_config": "benchmark", "retrieval": "retrieval", "evaluation": "evaluation"}.items()}
    models = {f"{name}_model": model_record(config["models"][name]) for name in ("generator", "dense")}
    made = {"benchmark_version": config["experiment_version"], "dataset_sha256": corpus_digest, "nodes_sha256": nodes_digest, "node_count": node_count}
    return made | kept | models | {"heading_rules_sha256": file_sha256(heading_rules), "dependencies": installed_versions(), "frozen": False}


def settings_errors(config: Mapping[str, Any], manifest: Mapping[str, Any], heading_rules: str | Path) -> list[str]:
    """Settings that are not those a benchmark was prepared with."""
    now = base_manifest(config, "", "", 0, heading_rules)
    return [k for k in ("seed", "chunk", "heading_rules_sha256", "evidence_config", "benchmark_config", "generator_model") if manifest.get(k) != now[k]]


def load_corpus(spark: SparkSession, path: str, digest: str | None = None, per_family: int = 60) -> DataFrame:
    if digest is not None:
        same_digest(spark, path, digest, "the corpus")
    jobs = read_jsonl(spark, path, JOBS, check=True)
    require_none(corpus_errors(jobs, per_family))
    return jobs


def load_nodes(spark: SparkSession, path: str, manifest: Mapping[str, Any]) -> DataFrame:
    same_digest(spark, path, manifest.get("nodes_sha256"), "the table of passages")
    nodes = read_jsonl(spark, path, NODES, check=True)
    need(nodes.count() == manifest.get("node_count"), "the number of passages is not the manifest's")
    return nodes


def load_frozen(spark: SparkSession, folder: str | Path, jobs: DataFrame, nodes: DataFrame, manifest: Mapping[str, Any], per_family: int, families: Sequence[str] = FAMILIES) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of a frozen benchmark, with its digests and all its rules checked."""
    need(manifest.get("frozen") is True, "the benchmark is not frozen")
    tables = []
    for name, schema in (("queries", QUERIES), ("qrels", QRELS)):
        path = Path(folder) / f"{name}.jsonl"
        same_digest(spark, path, manifest.get(f"{name}_sha256"), name)
        tables.append(read_jsonl(spark, str(path), schema, check=True))
    require_valid(jobs, nodes, *tables, expected_pairs=per_family * len(families), expected_per_family=per_family, families=tuple(families))
    return tables[0], tables[1]


def load_run(spark: SparkSession, benchmark: str | Path, run: str | Path, top_k: int = 20) -> dict[str, Any]:
    """The tables and manifests of a finished run over a frozen benchmark, held to each other and scored once."""
    benchmark, run = Path(benchmark), Path(run)
    frozen, ran = read_manifest(benchmark), read_manifest(run)
    need(frozen.get("benchmark_version") == "jd_v2" and frozen.get("frozen") is True, "the benchmark is not a frozen one")
    tables = {name: read_jsonl(spark, str(benchmark / f"{name}.jsonl"), schema) for name, schema in (("nodes", NODES), ("queries", QUERIES), ("qrels", QRELS))}
    for name in tables:
        digest = same_digest(spark, benchmark / f"{name}.jsonl", frozen.get(f"{name}_sha256"), name)
        need(ran.get(f"{name}_sha256") == digest, f"the run used other {name}")
    need(ran.get("benchmark_manifest_sha256") == file_sha256(benchmark / "manifest.json"), "the run used another manifest")
    need(ran.get("dataset_sha256") == frozen.get("dataset_sha256"), "the run used another corpus")
    same_digest(spark, run / "retrieval_results.jsonl", ran.get("retrieval_results_sha256"), "the results")
    need(ran.get("run_id") == run.name and isinstance(ran.get("config_sha256"), str), "the run's identity is not its folder's")
    results = read_jsonl(spark, str(run / "retrieval_results.jsonl"), RESULTS)
    n = {name: table.count() for name, table in (*tables.items(), ("results", results))}
    need(n["nodes"] == frozen.get("node_count") and n["queries"] == frozen.get("query_count") == 2 * frozen.get("pair_count", -1), "counts are not the manifest's")
    need(n["qrels"] == n["queries"] and n["results"] == 3 * n["queries"], "a table has too few or too many rows")
    strange = results.where((F.col("run_id") != ran["run_id"]) | (F.col("config_hash") != ran["config_sha256"])).limit(1).count()
    need(not strange, "results of another run")
    require_none(duplicates(tables["nodes"], "node", "node_id").union(ranking_errors(results, tables["nodes"], top_k)))
    evaluate_results(results, tables["qrels"], tables["queries"])
    return tables | {"results": results, "benchmark_manifest": frozen, "run_manifest": ran}


def run_manifest(spark: SparkSession, run_id: str, config: Mapping[str, Any], manifest: Mapping[str, Any], manifest_path: str | Path, results_path: str | Path, rows: int, model_files: Mapping[str, Any]) -> dict[str, Any]:
    """What a run was made of and with."""
    same = {k: manifest.get(k) for k in ("dataset_sha256", "nodes_sha256", "queries_sha256", "qrels_sha256")}
    own = {"run_id": run_id, "config_sha256": object_sha256(config), "benchmark_manifest_sha256": file_sha256(manifest_path), "retrieval_results_sha256": digest_of(spark, results_path), "result_row_count": rows}
    return own | same | {"retrieval": config["retrieval"], "dense_model": model_record(config["models"]["dense"]), "dense_snapshot": dict(model_files), "dependencies": installed_versions()}

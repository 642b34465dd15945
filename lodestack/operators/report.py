"""Failure cases and the files of a report. What grows with pairs or queries is rendered by tasks, the rest on the driver."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import short_text
from lodestack.operators.evaluate import KINDS, METHODS, evaluate_results, require_none
from lodestack.operators.lexical import rows_of
from lodestack.operators.pairs import ranking_errors
from lodestack.sources.files import write_bytes, write_csv, write_json, write_lines
from lodestack.storage import written

#: Names and columns of the files, the names of metrics there, and sentences.
SHOWN = {"high_hit": "high_source_evidence_hit_at_5", "low_hit": "low_source_evidence_hit_at_5", "hit_drop": "hit_drop", "high_rr": "high_source_evidence_mrr_at_5", "low_rr": "low_source_evidence_mrr_at_5", "rr_drop": "mrr_drop"}
METRIC_COLUMNS = tuple(SHOWN.values())
INTERVAL_COLUMNS = ("ci_lower", "ci_upper", "confidence", "bootstrap_samples", "pair_count")
FILES = {
    "main_table": ("main_table.csv", ("method", "pair_count", *METRIC_COLUMNS)),
    "pair_outcomes": ("pair_transitions.csv", ("pair_id", "method", "source_job_family", "high_query_id", "low_query_id", *METRIC_COLUMNS[:2], "transition", *METRIC_COLUMNS[3:5], "hit_drop", "mrr_drop")),
    "transition_summary": ("transition_summary.csv", ("method", "transition", "count", "fraction")),
    "bootstrap_intervals": ("bootstrap_intervals.csv", ("method", "metric", "estimate", *INTERVAL_COLUMNS)),
    "method_drop_differences": ("method_drop_differences.csv", ("method_a", "method_b", "metric", "drop_difference", *INTERVAL_COLUMNS)),
    "family_descriptive": ("family_descriptive.csv", ("method", "source_job_family", "pair_count", *METRIC_COLUMNS)),
}
RERANK_FILES = {
    "main_table": FILES["main_table"],
    "candidate_coverage": ("candidate_coverage.csv", ("query_type", "candidate_source", "query_count", "source_evidence_in_candidates", "source_evidence_candidate_coverage")),
    "bootstrap_intervals": ("bootstrap_intervals.csv", ("method", "metric", "estimate", *INTERVAL_COLUMNS[:4])),
    "paired_differences": ("paired_differences.csv", ("new_method", "baseline", "metric", "difference", *INTERVAL_COLUMNS[:4])),
}
RENAMED = {
    "pair": "pair_id", "family": "source_job_family", "high_query": "high_query_id", "low_query": "low_query_id", "pairs": "count", "share": "fraction",
    "low": "ci_lower", "high": "ci_upper", "kind": "query_type", "covered": "source_evidence_in_candidates", "coverage": "source_evidence_candidate_coverage",
} | SHOWN
RENAMED_IN = {"method_drop_differences": {"difference": "drop_difference"}, "paired_differences": {"method_a": "new_method", "method_b": "baseline"}, "candidate_coverage": {"method": "candidate_source"}}
JUDGMENT = "A miss: no passage that holds the question's own evidence is among the first five. Passages of other sources may answer it all the same; nobody has labeled them."
LIMIT = "Only the originating evidence of a question is labeled: these numbers are neither recall nor precision nor answer quality."
EXCERPT = 180


def diagnosis(gold: Column, source: Column) -> Column:
    """What became of the evidence in a list of twenty, from the first ranks of its passages and of its source."""
    return (
        F.when(gold <= 5, F.format_string("Source evidence found at rank %d.", gold))
        .when(gold.isNotNull(), F.format_string("Source evidence found at rank %d, outside Top-5.", gold))
        .when(source <= 5, F.lit("Top-5 contains a different chunk from the source JD; the labeled evidence is absent from Top-20."))
        .when(source.isNotNull(), F.format_string("The source JD first appears at rank %d, but the labeled evidence is absent from Top-20.", source))
        .otherwise(F.lit("The source JD is absent from Top-20."))
    )


def failure_cases(results: DataFrame, scores: DataFrame, queries: DataFrame, nodes: DataFrame, most: int = 12, methods: Sequence[str] = METHODS) -> DataFrame:
    """Queries that some method misses, the worst first: by how many methods miss, questions in other words first, then by id.

    (place, query_id, pair_id, query_type, query, source_job_id, evidence_text, evidence_node_ids, method, hit, diagnosis, top5), a row per method."""
    if most < 0:
        raise ValueError("a number of cases is not negative")
    hits = scores.select("query_id", "method", F.col("source_evidence_hit_at_5").alias("hit"), "evidence_node_ids")
    per_query = hits.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")).where("hits < n").join(queries, "query_id")
    some = F.when(F.col("hits") == 0, 0).otherwise(2)
    ordered = per_query.withColumn("priority", some + F.when(F.col("query_type") == KINDS[1], 0).otherwise(1)).orderBy("priority", "query_id").limit(most)
    chosen = ordered.select("priority", "query_id", "pair_id", "query_type", "query", "source_job_id", "evidence_text")
    chosen = written(chosen, "worst")
    listed = results.join(F.broadcast(chosen.select("query_id", "source_job_id")), "query_id").select("query_id", "method", "source_job_id", F.posexplode("ranked_node_ids").alias("at", "node_id"))
    listed = written(listed, "listed")
    about = rows_of(nodes, listed, "node_id").select("node_id", "job_id", "title", "company", "section_heading", short_text("content_text", EXCERPT).alias("excerpt"))
    listed = listed.withColumn("rank", F.col("at") + 1).join(about, "node_id").join(hits, ["query_id", "method"])
    shown = F.struct("rank", "node_id", "job_id", "title", "company", "section_heading", "excerpt")
    found = listed.groupBy("query_id", "method").agg(
        F.min(F.when(F.array_contains("evidence_node_ids", F.col("node_id")), F.col("rank"))).alias("gold"),
        F.min(F.when(F.col("job_id") == F.col("source_job_id"), F.col("rank"))).alias("source"),
        F.max("hit").alias("hit"), F.first("evidence_node_ids").alias("evidence_node_ids"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, shown))).alias("top5"),
    )
    rows = chosen.join(found, "query_id").where(F.col("method").isin(*methods)).withColumn("diagnosis", diagnosis(F.col("gold"), F.col("source")))
    return rows.select("priority", "query_id", "pair_id", "query_type", "query", "source_job_id", "evidence_text", "evidence_node_ids", "method", "hit", "diagnosis", "top5")


def _cases(rows: Sequence[Any], methods: Sequence[str]) -> list[dict[str, Any]]:
    """One mapping per query of the collected ``failure_cases``."""
    out: dict[str, dict[str, Any]] = {}
    for r in sorted(rows, key=lambda r: (r["priority"], r["query_id"], methods.index(r["method"]))):
        case = out.setdefault(r["query_id"], {k: r[k] for k in ("query_id", "pair_id", "query_type", "query", "source_job_id", "evidence_text", "evidence_node_ids")} | {"method_hits": {}, "method_diagnoses": {}, "top5": {}, "judgment": JUDGMENT})
        case["method_hits"][r["method"]], case["method_diagnoses"][r["method"]] = r["hit"], r["diagnosis"]
        case["top5"][r["method"]] = [t.asDict() for t in r["top5"]]
    return list(out.values())


def render_failures(cases: Sequence[Mapping[str, Any]]) -> str:
    as_json = lambda text: json.dumps(text, ensure_ascii=False)
    blocks = ["# Failure cases", "A different passage may answer a question too; only its own evidence is labeled." if cases else "No source-evidence misses were found in this run."]
    for number, case in enumerate(cases, 1):
        blocks.append(f"## {number}. {case['query_id']} ({case['query_type']})")
        ids = ", ".join(f"`{x}`" for x in case["evidence_node_ids"])
        blocks.append("\n".join((
            f"- Pair: `{case['pair_id']}`; source JD: `{case['source_job_id']}`", f"- Query: {as_json(case['query'])}", f"- Source evidence: {as_json(case['evidence_text'])}",
            f"- Source evidence node IDs: {ids}", f"- Judgment: {case['judgment']}",
        )))
        for method, hit in case["method_hits"].items():
            blocks += [f"### {method} — {'hit' if hit else 'miss'}", case["method_diagnoses"][method]]
            blocks.append("\n".join(f"{t['rank']}. `{t['node_id']}` | JD `{t['job_id']}` | {t['title']} ({t['company']}), section: {t['section_heading'] or ''}. Excerpt: {as_json(t['excerpt'])}" for t in case["top5"][method]))
    return "\n\n".join(blocks) + "\n"


def render_summary(title: str, main: Sequence[Mapping[str, Any]], notes: Sequence[str]) -> str:
    head = ("Method", "High Hit@5", "Low Hit@5", "Hit drop", "High MRR@5", "Low MRR@5", "MRR drop")
    rows = [f"| {' | '.join(head)} |", f"| --- |{' ---: |' * len(METRIC_COLUMNS)}"]
    rows += [f"| {r['method']} | " + " | ".join(f"{r[c]:.3f}" for c in METRIC_COLUMNS) + " |" for r in main]
    return "\n\n".join([f"# {title}", "\n".join(rows), *notes]) + "\n"


def _named(name: str, table: DataFrame, extra: Mapping[str, Any]) -> tuple[DataFrame, Callable[[dict[str, Any]], dict[str, Any]]]:
    """A table in order, and how its rows are shown: under the names of files, with ``extra``."""
    again, more = RENAMED | RENAMED_IN.get(name, {}), dict(extra)
    first = [c for c, kind in table.dtypes if kind == "string"]
    ordered = table.orderBy(*first, *(c for c in table.columns if c not in first))
    return ordered, lambda row: {again.get(k, k): SHOWN.get(v, v) if k == "metric" else v for k, v in row.items()} | more


def _collected(tables: Mapping[str, DataFrame], extra: Mapping[str, Any]) -> dict[str, list[dict[str, Any]]]:
    """The tables of an analysis that have a row for each method, metric or family."""
    out = {}
    for name, table in tables.items():
        rows, shown = _named(name, table, extra)
        out[name] = [shown(r.asDict()) for r in rows.collect()]
    return out


def _rendered(rows: DataFrame, render: Callable[[dict[str, Any]], str]) -> DataFrame:
    """(value): the rows as texts, made where they lie and in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([render(r) for r in batch.to_pylist()], pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def _csv_row(columns: Sequence[str], values: Mapping[str, Any]) -> str:
    """A row without its line feed."""
    out = io.StringIO(newline="")
    csv.DictWriter(out, columns, extrasaction="ignore").writerow(values)
    return out.getvalue().removesuffix("\n")


def _json_row(values: Mapping[str, Any], last: bool) -> str:
    """A row as an item of a list that is a field of an object."""
    return "\n".join("    " + line for line in json.dumps(values, indent=2, sort_keys=True, ensure_ascii=False).split("\n")) + ("" if last else ",")


def _write_analysis(path: Path, about: Mapping[str, Any], name: str, rows: DataFrame, shown: Callable[[dict[str, Any]], dict[str, Any]]) -> Path:
    """``about`` as JSON, with the list ``name`` of all ``rows``, which may be many."""
    mark = f"@{name}@"
    head, tail = (json.dumps({**about, name: mark}, indent=2, sort_keys=True, ensure_ascii=False) + "\n").split(json.dumps(mark))
    first = [c for c, kind in rows.dtypes if kind == "string"]
    order = [*first, *(c for c in rows.columns if c not in first)]
    end = rows.agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if end is None:
        return write_bytes(path, f"{head}[]{tail}".encode(), overwrite=True)
    is_last = F.lit(True)
    for c in order:
        is_last = is_last & F.col(c).eqNullSafe(F.lit(end[c]))
    texts = _rendered(rows.withColumn("_last", is_last), lambda r: _json_row(shown({k: v for k, v in r.items() if k != "_last"}), r["_last"]))
    return write_lines(texts, path, f"{head}[\n", f"  ]{tail}")


def write_reports(tables: Mapping[str, DataFrame], results: DataFrame, queries: DataFrame, qrels: DataFrame, nodes: DataFrame, folder: str | Path, replicates: int, confidence: float = 0.95, seed: int | None = None, most: int = 12) -> dict[str, Path]:
    """The tables as CSV, scores as JSON lines, failure cases and a summary as Markdown, and all as JSON.

    The run is evaluated again; an analysis of other pairs is refused. Tables with a row for each pair or
    query are written by tasks; what comes to the driver has a row for each method, metric or family,
    and the failure cases."""
    scores = evaluate_results(results, qrels, queries)
    require_none(ranking_errors(results, nodes, 20).where("error = 'unknown_node'"))
    scores = written(scores, "scores")
    ours, theirs = scores.select(F.col("pair_id").alias("pair")).distinct(), tables["pair_outcomes"].select("pair").distinct()
    n_pairs = ours.count()
    if ours.join(theirs, "pair", "left_anti").limit(1).count() or theirs.join(ours, "pair", "left_anti").limit(1).count():
        raise ValueError("the analysis is of other pairs than the results")
    extra = {"confidence": confidence, "bootstrap_samples": replicates, "pair_count": n_pairs}
    shown = _collected({k: t for k, t in tables.items() if k != "pair_outcomes"}, extra)
    outcomes, as_shown = _named("pair_outcomes", written(tables["pair_outcomes"], "outcomes"), extra)
    folder, paths = Path(folder), {}
    for name, (file, columns) in FILES.items():
        if name in shown:
            paths[name] = write_csv(folder / file, shown[name], columns)
        else:
            header = _csv_row(columns, dict(zip(columns, columns, strict=True))) + "\n"
            paths[name] = write_lines(_rendered(outcomes, lambda r, c=columns: _csv_row(c, as_shown(r))), folder / file, header)
    number = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    lines = _rendered(scores.orderBy("query_id", number), lambda r: json.dumps(r, ensure_ascii=False, sort_keys=True))
    paths["per_query_scores"] = write_lines(lines, folder / "per_query_scores.jsonl")
    cases = _cases(failure_cases(results, scores, queries, nodes, most).collect(), METHODS)
    paths["failure_cases"] = write_bytes(folder / "failure_cases.md", render_failures(cases).encode(), overwrite=True)
    run = scores.select("run_id", "config_hash").first()
    about = {"run_id": run["run_id"], "config_hash": run["config_hash"], "pair_count": n_pairs, "query_count": 2 * n_pairs, "bootstrap_seed": seed, "bootstrap_samples": replicates, "bootstrap_confidence": confidence, "interpretation_limit": LIMIT}
    notes = (f"Run `{about['run_id']}`: {n_pairs} pairs.", "A positive drop: the question in other words scored worse.", LIMIT)
    paths["summary"] = write_bytes(folder / "summary.md", render_summary("Evidence retrieval", shown["main_table"], notes).encode(), overwrite=True)
    paths["analysis"] = _write_analysis(folder / "analysis.json", about | shown | {"failure_cases": cases}, "pair_outcomes", outcomes, as_shown)
    return paths


def write_rerank_report(tables: Mapping[str, DataFrame], folder: str | Path, replicates: int, confidence: float = 0.95) -> dict[str, Path]:
    """The tables of ``analyze_reranked`` in a folder that must not exist yet."""
    folder = Path(folder)
    folder.mkdir(parents=True)
    small = {k: t for k, t in tables.items() if k in RERANK_FILES}
    shown = _collected(small, {"confidence": confidence, "bootstrap_samples": replicates})
    drop = {"main_table": ("confidence", "bootstrap_samples"), "candidate_coverage": ("confidence", "bootstrap_samples")}
    for name, gone in drop.items():
        shown[name] = [{k: v for k, v in r.items() if k not in gone} for r in shown[name]]
    paths = {name: write_csv(folder / file, shown[name], columns, extra="raise", overwrite=False) for name, (file, columns) in RERANK_FILES.items()}
    spent = tables["mean_rerank_ms_per_query"].first()[0]
    paths["analysis"] = write_json(folder / "analysis.json", shown | {"mean_rerank_ms_per_query": spent, "interpretation_limit": LIMIT})
    paths["summary"] = write_bytes(folder / "summary.md", render_summary("Local reranking", shown["main_table"], (f"Mean reranker inference: {spent:.1f} ms per query.", LIMIT)).encode())
    return paths

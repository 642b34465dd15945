"""Building a benchmark: seeded order of sources, questions by a generator, quotas by waves.

A wave takes, of every family, as many further sources in seeded order as its quota still
lacks, and asks the generator for all of them in parallel. Accepted sources are counted in
seeded order, so the result is that of asking one source after another and stopping at the
quota: a wave never holds a source that a serial run would not have reached."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import seeded_key
from lodestack.operators.evaluate import KINDS, enclosing, require_none
from lodestack.operators.numbering import numbered
from lodestack.operators.pairs import FLAGS, JOB_FIELDS, family_shortfall, pair_errors, semantic_errors
from lodestack.sources.files import write_jsonl
from lodestack.sources.settings import FAMILIES


class PairGenerator(Protocol):
    """A model that proposes pairs and judges them; ValueError means that its answer could not be read."""

    name: str
    revision: str | None

    def generate_pair(self, evidence_text: str, *, rejection_reason: str | None = None) -> Mapping[str, Any]: ...

    def validate_pair(self, evidence_text: str, high_query: str, low_query: str, anchor_term: str) -> Mapping[str, Any]: ...


@dataclass(frozen=True)
class Quotas:
    per_family: int = 20
    attempts: int = 2
    candidates_per_job: int = 8
    review_sample: int = 8

    def __post_init__(self) -> None:
        if min(self.per_family, self.attempts, self.candidates_per_job) < 1 or self.review_sample < 0:
            raise ValueError("quotas and attempts are positive")


def job_order(jobs: DataFrame, seed: int, id_col: str = "id", family_col: str = "job_family") -> DataFrame:
    """``jobs`` with ``place``: the seeded order within each family."""
    keyed = jobs.withColumns({"_key": seeded_key(seed, F.col(id_col)), "_id": F.col(id_col).cast("string")})
    return numbered(keyed, family_col, ["_key", "_id"], "place").drop("_key", "_id")


def candidate_order(candidates: DataFrame, seed: int, most: int) -> DataFrame:
    """The ``most`` best candidates of every source with ``choice``: the more distinctive first, ties by seeded order."""
    order = Window.partitionBy("source_job_id").orderBy(F.desc("distinctiveness_score"), seeded_key(seed, F.col("candidate_id")))
    return candidates.withColumn("choice", F.row_number().over(order).cast("long")).where(F.col("choice") <= most)


def sample_by_seed(df: DataFrame, seed: int, key: str, most: int) -> DataFrame:
    """The first ``most`` keys by the digest of [seed, key] as canonical JSON."""
    digest = F.sha2(F.concat(F.lit(f"[{seed},"), F.regexp_extract(F.to_json(F.array(F.col(key).cast("string"))), r"(?s)^\[(.*)\]$", 1), F.lit("]")), 256)
    return df.select(key).distinct().orderBy(digest).limit(most)


def sound_candidates(candidates: DataFrame, jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``candidates`` with ``sound``: they stand once in their source, where they say, and their passages are all that hold them."""
    whole = jobs.select(F.col("id").alias("source_job_id"), F.col("description_clean").alias("whole"))
    start, end = F.col("evidence_start").cast("int"), F.col("evidence_end").cast("int")
    placed = candidates.join(whole, "source_job_id").withColumns({"job": F.col("source_job_id"), "start": start, "end": end})
    held = enclosing(placed, nodes.select(F.col("job_id").alias("job"), "node_id", "start_offset", "end_offset"))
    text = F.col("evidence_text")
    times = (F.length("whole") - F.length(F.replace(F.col("whole"), text))) / F.length(text)
    sound = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("whole"))
    sound = sound & (F.substr("whole", F.col("start") + 1, F.col("end") - F.col("start")) == text) & (times == 1)
    sound = sound & (F.size("node_ids") > 0) & (F.array_sort("evidence_node_ids") == F.col("node_ids"))
    return held.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("whole", "job", "start", "end", "node_ids")


def ask(generator: PairGenerator, evidence: str, job: Mapping[str, Any], attempts: int) -> tuple[Mapping[str, Any] | None, list[dict]]:
    """(the accepted pair with its flags or None, the rejected attempts); what was wrong is told to the next attempt."""
    rejected: list[dict] = []
    why = None
    for attempt in range(1, attempts + 1):
        pair, flags, detail = {}, {}, None
        try:
            pair = generator.generate_pair(evidence, rejection_reason=why)
            errors = pair_errors(pair, evidence, job)
        except ValueError as error:
            errors, detail = ["generation_json_invalid"], str(error)
        if not errors:
            try:
                flags = generator.validate_pair(evidence, *(str(pair[k]) for k in ("high_query", "low_query", "anchor_term")))
                errors, detail = semantic_errors(flags), str(flags.get("reason", ""))
            except ValueError as error:
                errors, detail = ["semantic_json_invalid"], str(error)
        if not errors:
            return {**pair, "flags": {f: True for f in FLAGS}}, rejected
        why = ", ".join(errors)
        rejected.append({"attempt": attempt, "reasons": errors, "detail": None if detail is None else detail[:300]})
    return None, rejected


_ASKED = "source_job_id string, family string, place long, candidate_id string, choice long, high_query string, low_query string, anchor_term string, attempt long, reasons array<string>, detail string"


def ask_sources(options: DataFrame, make_generator: Callable[[], PairGenerator], attempts: int) -> DataFrame:
    """One row per accepted pair (reasons null) and per rejected attempt; a source's candidates are tried until one is accepted.

    ``options``: (family, place, id and other fields of the job, candidate_id, choice, evidence_text, sound)."""
    fields = [f for f in JOB_FIELDS if f in options.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                job = {f: row[f] for f in fields}
                for option in sorted(row["options"], key=lambda o: o["choice"]):
                    head = (row["id"], row["family"], row["place"], option["candidate_id"], option["choice"])
                    if not option["sound"]:
                        out.append((*head, None, None, None, None, ["candidate_source_integrity"], None))
                        continue
                    generator = generator or make_generator()
                    pair, rejected = ask(generator, option["evidence_text"], job, attempts)
                    out.extend((*head, None, None, None, r["attempt"], r["reasons"], r["detail"]) for r in rejected)
                    if pair is not None:
                        out.append((*head, *(str(pair[k]).strip() for k in ("high_query", "low_query", "anchor_term")), len(rejected) + 1, None, None))
                        break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ASKED.split(", ")])

    packed = options.groupBy("family", "place", *fields).agg(F.collect_list(F.struct("candidate_id", "choice", "evidence_text", "sound")).alias("options"))
    return packed.mapInPandas(run, _ASKED)


def build_benchmark(jobs: DataFrame, nodes: DataFrame, candidates: DataFrame, make_generator: Callable[[], PairGenerator], store: Callable[[DataFrame, str], DataFrame], quotas: Quotas = Quotas(), seed: int = 42, families: Sequence[str] = FAMILIES, generator_name: str = "", generator_revision: str | None = None, prompt_version: str = "", validation_prompt_version: str = "") -> dict[str, Any]:  # noqa: B008
    """Tables ``queries``, ``qrels`` and ``rejections``, and ``counts``.

    ``store`` writes a table under a name and reads it back: a wave is asked once. A driver
    loop over waves is needed, since a wave depends on what the last one accepted; what
    comes to the driver is one number for each family. A source takes part with its best
    ``candidates_per_job`` candidates."""
    unknown = candidates.select(F.col("source_job_id").alias("id")).distinct().join(jobs.select("id"), "id", "left_anti")
    require_none(unknown.select(F.lit("candidate").alias("scope"), F.col("id").alias("key"), F.lit("unknown_source").alias("error")))
    ordered = job_order(jobs, seed).withColumnRenamed("job_family", "family").where(F.col("family").isin(*families))
    best = sound_candidates(candidate_order(candidates, seed, quotas.candidates_per_job), jobs, nodes)
    fields = [f for f in JOB_FIELDS if f in jobs.columns]
    options = ordered.select("family", "place", *fields).join(best.select(F.col("source_job_id").alias("job"), "candidate_id", "choice", "evidence_text", "sound"), F.col("id") == F.col("job")).drop("job")
    options = store(options, "options")
    last = {r["family"]: r["last"] for r in ordered.groupBy("family").agg(F.max("place").alias("last")).collect()}
    at, accepted, waves = dict.fromkeys(families, 0), dict.fromkeys(families, 0), []
    while wave := {f: at[f] + quotas.per_family - accepted[f] for f in families if accepted[f] < quotas.per_family and at[f] < last.get(f, 0)}:
        chosen = F.lit(False)
        for family, end in wave.items():
            chosen = chosen | ((F.col("family") == family) & F.col("place").between(at[family] + 1, end))
        waves.append(store(ask_sources(options.where(chosen), make_generator, quotas.attempts), f"wave-{len(waves)}"))
        at |= wave
        for row in waves[-1].where("reasons IS NULL").groupBy("family").count().collect():
            accepted[row["family"]] += row["count"]
    asked = waves[0] if waves else jobs.sparkSession.createDataFrame([], _ASKED)
    for more in waves[1:]:
        asked = asked.union(more)
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family"))
    in_order = asked.where("reasons IS NULL").withColumn("number", F.row_number().over(Window.orderBy(number, "place")))
    pairs = in_order.join(candidates.drop("source_job_id", "source_job_family"), "candidate_id").withColumn("pair_id", F.format_string("pair_%03d", "number"))
    flags = F.struct(*(F.lit(True).alias(f) for f in FLAGS))
    named = pairs.withColumnsRenamed({"family": "source_job_family"}).withColumns({
        "generator_model": F.lit(generator_name), "generator_revision": F.lit(generator_revision).cast("string"), "prompt_version": F.lit(prompt_version),
        "validation_prompt_version": F.lit(validation_prompt_version), "validation_status": F.lit("passed"), "semantic_validation": flags,
    })
    common = [
        "pair_id", "source_job_id", "source_job_family", "evidence_text", "evidence_start", "evidence_end", "evidence_node_ids", "anchor_term",
        "generator_model", "generator_revision", "prompt_version", "validation_prompt_version", "validation_status", "semantic_validation",
    ]
    sides = F.explode(F.array(*(F.struct(F.lit(end).alias("end"), F.lit(kind).alias("query_type"), F.col(col).alias("query")) for end, kind, col in zip(("high", "low"), KINDS, ("high_query", "low_query"), strict=True))))
    queries = named.select(*common, sides.alias("side")).select(F.concat_ws("_", "pair_id", "side.end").alias("query_id"), "side.query_type", "side.query", *common)
    counts = {
        "target_pairs": quotas.per_family * len(families), "accepted_pairs": sum(accepted.values()), "accepted_pairs_by_family": accepted, "candidate_count": candidates.count(),
        "attempted_candidates": asked.select("candidate_id").distinct().count(), "attempted_generations": asked.where("attempt IS NOT NULL").count(),
        "rejection_reasons": {r["r"]: r["count"] for r in asked.select(F.explode("reasons").alias("r")).groupBy("r").count().collect()},
    }
    return {
        "queries": queries, "qrels": queries.select("query_id", "pair_id", "source_job_id", "evidence_node_ids"),
        "rejections": asked.where("reasons IS NOT NULL").select("candidate_id", "source_job_id", "attempt", "reasons", "detail"), "counts": counts,
    }


def review_sample(queries: DataFrame, seed: int, most: int) -> DataFrame:
    """The questions of the pairs that ``sample_by_seed`` takes."""
    return queries.join(F.broadcast(sample_by_seed(queries, seed, "pair_id", most)), "pair_id", "left_semi")


def write_benchmark(queries: DataFrame, qrels: DataFrame, folder: str | Path, per_family: int, families: Sequence[str] = FAMILIES, overwrite: bool = False) -> tuple[str, str]:
    """Questions and gold links as JSON lines, if every family has its quota; what is there is not replaced unless told so."""
    require_complete(queries, per_family, families)
    paths = [str(Path(folder) / f"{name}.jsonl") for name in ("queries", "qrels")]
    if not overwrite and any(Path(p).exists() for p in paths):
        raise FileExistsError(paths[0])
    for table, path in zip((queries, qrels), paths, strict=True):
        write_jsonl(table.orderBy("query_id"), path, overwrite)
    return paths[0], paths[1]


def require_complete(queries: DataFrame, per_family: int, families: Sequence[str] = FAMILIES) -> None:
    """Raises where some family has not its quota of distinct sources."""
    require_none(family_shortfall(queries, per_family, tuple(families)))

"""Checks of question pairs and of a whole benchmark.

A pair is two questions for one piece of evidence: one that shares words with it, and one
that says the same in others. Tables of pairs are checked by expressions (``pair_error_column``);
``pair_errors`` is the same for one pair that a generator has just made. The checks of tables
against each other are joins and aggregates that give rows (scope, key, error)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import NUMBER, QUESTION_STOP_WORDS, SPACES, TOKEN, lexical_terms, numbers, one_line
from lodestack.functions.text import has_phrase as phrase_in
from lodestack.operators.evaluate import KINDS, enclosing, require_none

#: Flags that a judge must set, fields that both questions share, and limits.
FLAGS = (
    "role_related_atomic_fact", "self_contained_evidence", "same_information_need", "high_supported",
    "low_supported", "constraints_preserved", "natural_questions", "low_is_conceptual_paraphrase",
)
SHARED = ("source_job_id", "source_job_family", "evidence_text", "evidence_start", "evidence_end", "anchor_term", "evidence_node_ids")
QUERY_CHARS, ANCHOR_CHARS, ANCHOR_WORDS, COMPANY_CHARS = (20, 320), (3, 80), 3, 4
#: What is a link, what does not name a company, and what does not name a role.
LINK = re.compile(r"(?:https?://|www\.|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s]+)", re.I)
LEGAL_WORDS = frozenset("inc llc ltd limited corp corporation company group gmbh ag plc co the".split())
RANKS = re.compile(r"(?:(?:senior|sr|junior|jr|principal|staff|lead|associate|mid.level|entry.level)\s+)+", re.I)
HOST = r"\A(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?\[?((?<=\[)[^\]/?#]*|[^/?#:@\[\]]*)"
GRADE = re.compile(r"\s+(?:I|II|III|IV|V)$")
_TOKEN, _NUMBER = re.compile(TOKEN.replace("(?iU)", ""), re.I), re.compile(NUMBER.replace("(?U)", ""))


def _flat(text: str) -> str:
    return " ".join(re.split(r"\s+", text)).casefold()


def has_phrase(text: str, phrase: str) -> bool:
    bare = phrase.strip()
    return bare != "" and re.search(rf"(?<!\w){re.escape(bare)}(?!\w)", text, re.I) is not None


def _terms(text: str) -> set[str]:
    return {t.casefold() for t in _TOKEN.findall(text)}.difference(QUESTION_STOP_WORDS)


def title_core(title: str) -> str:
    """The role without its rank, what follows a comma, and its grade."""
    ranked = RANKS.match(title)
    return GRADE.sub("", title[ranked.end() if ranked else 0 :].partition(",")[0].strip())


def company_words(company: str) -> list[str]:
    return [w for w in re.findall(r"[A-Za-z][A-Za-z0-9-]*", company) if len(w) >= COMPANY_CHARS and w.casefold() not in LEGAL_WORDS]


def source_leaks(query: str, job: Mapping[str, Any]) -> list[str]:
    """What of the source a question gives away: its link, company, title or identifiers."""
    value = {k: str(job.get(k) or "") for k in ("company", "title", "id", "source_job_id", "url")}
    core, host = title_core(value["title"]), urlsplit(value["url"]).hostname
    phrases = [(k, value[k]) for k in ("company", "title", "id", "source_job_id")] + [("company", w) for w in company_words(value["company"])]
    if core.casefold() != value["title"].casefold():
        phrases.append(("title", core))
    found = {name for name, phrase in phrases if has_phrase(query, phrase)}
    at_host = host and re.search(rf"(?<![\w.]){re.escape(host)}(?![\w.])", query, re.I)
    if LINK.search(query) or at_host or (value["url"] and value["url"].casefold() in query.casefold()):
        found.add("url")
    return sorted(found)


def pair_errors(pair: Mapping[str, Any], evidence: str, job: Mapping[str, Any]) -> list[str]:
    """What is wrong with a proposed pair (high_query, low_query, anchor_term), as far as words show; empty if nothing is."""
    parts = [pair.get(k) for k in ("high_query", "low_query", "anchor_term")]
    if not all(isinstance(p, str) and p.strip() for p in parts):
        return ["missing_or_non_string_query_or_anchor"]
    high, low, anchor = (p.strip() for p in parts)
    terms, asked, flat = _terms(evidence), {"high": high, "low": low}, _flat(evidence).strip()
    shared = {side: len(_terms(q) & terms) for side, q in asked.items()}
    fits = ANCHOR_CHARS[0] <= len(anchor) <= ANCHOR_CHARS[1] and len(anchor.split()) <= ANCHOR_WORDS
    checks = [
        ("query_length", not all(QUERY_CHARS[0] <= len(q) <= QUERY_CHARS[1] for q in asked.values())),
        ("identical_questions", high.casefold() == low.casefold()),
        ("anchor_absent_or_invalid", not fits or not has_phrase(evidence, anchor)),
        ("high_missing_anchor", not has_phrase(high, anchor)),
        ("low_repeats_anchor", has_phrase(low, anchor)),
        ("low_not_lower_lexical_overlap", shared["high"] <= shared["low"]),
    ]
    for side, query in asked.items():
        lost = sorted(set(_NUMBER.findall(evidence)) - set(_NUMBER.findall(query)))
        checks += [(f"{side}_not_question", query[-1] != "?"), (f"{side}_copies_whole_evidence", flat != "" and flat in _flat(query))]
        checks += [(f"{side}_leaks_{leak}", True) for leak in source_leaks(query, job)]
        checks.append((f"{side}_drops_numeric_constraint:{','.join(lost)}", bool(lost)))
    return [name for name, wrong in checks if wrong]


def semantic_errors(assessment: Mapping[str, Any]) -> list[str]:
    """The flags that a judge did not set to exactly true."""
    return [f"semantic_{flag}" for flag in FLAGS if assessment.get(flag) is not True]


JOB_FIELDS = ("company", "title", "id", "source_job_id", "url")


def _is(text: Column) -> Column:
    """``text`` without white space at its ends, as Python strips it; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\A(?U:[\s\x1c-\x1f])+|(?U:[\s\x1c-\x1f])+\z", "")


def folded(text: Column) -> Column:
    """``text`` without regard to case: lower case of its upper case, which spells out letters that have no other, and one small sigma.

    The step between the two keeps the optimizer from dropping the first."""
    return F.translate(F.lower(F.translate(F.upper(text), "\u03c2", "\u03c3")), "\u03c2", "\u03c3")


def title_core_column(title: Column) -> Column:
    """``title_core`` as an expression."""
    ranked = F.regexp_replace(title, rf"\A(?iU:{RANKS.pattern})", "")
    return F.regexp_replace(_is(F.regexp_extract(ranked, r"\A[^,]*", 0)), r"(?U:\s)+(?:I|II|III|IV|V)\z", "")


def company_words_column(company: Column) -> Column:
    """``company_words`` as an expression."""
    words = F.regexp_extract_all(company, F.lit(r"[A-Za-z][A-Za-z0-9-]*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= COMPANY_CHARS) & ~F.lower(w).isin(*sorted(LEGAL_WORDS)))


def leak_columns(query: Column, job: Mapping[str, Column]) -> dict[str, Column]:
    """``source_leaks`` as conditions, by name."""
    value = {k: F.coalesce(job[k].cast("string"), F.lit("")) if k in job else F.lit("") for k in JOB_FIELDS}
    core = title_core_column(value["title"])
    found = {k: phrase_in(query, value[k]) for k in ("company", "id", "source_job_id", "title")}
    found["company"] = found["company"] | F.exists(company_words_column(value["company"]), lambda w: phrase_in(query, w))
    found["title"] = found["title"] | ((folded(core) != folded(value["title"])) & phrase_in(query, core))
    host = F.lower(F.regexp_extract(value["url"], HOST, 1))
    literal = F.concat(F.lit(r"(?iU)(?<![\w.])\Q"), host, F.lit(r"\E(?![\w.])"))
    found["url"] = query.rlike(f"(?iU){LINK.pattern}") | ((host != "") & F.regexp(query, literal)) | ((value["url"] != "") & F.contains(folded(query), folded(value["url"])))
    return found


def pair_error_column(high: Column, low: Column, anchor: Column, evidence: Column, job: Mapping[str, Column]) -> Column:
    """``pair_errors`` as an array of texts, in the same order; ``job`` gives columns for some of JOB_FIELDS. Expressions only."""
    asked, said = {"high": _is(high), "low": _is(low)}, F.coalesce(evidence.cast("string"), F.lit(""))
    anchor = _is(anchor)
    terms, flat = lexical_terms(said), folded(one_line(said))
    shared = {side: F.size(F.array_intersect(lexical_terms(q), terms)) for side, q in asked.items()}
    fits = F.length(anchor).between(*ANCHOR_CHARS) & (F.size(F.split(anchor, SPACES)) <= ANCHOR_WORDS)
    checks: list[tuple[Column, Column]] = [
        (F.lit("query_length"), ~(F.length(asked["high"]).between(*QUERY_CHARS) & F.length(asked["low"]).between(*QUERY_CHARS))),
        (F.lit("identical_questions"), folded(asked["high"]) == folded(asked["low"])),
        (F.lit("anchor_absent_or_invalid"), ~fits | ~phrase_in(said, anchor)),
        (F.lit("high_missing_anchor"), ~phrase_in(asked["high"], anchor)),
        (F.lit("low_repeats_anchor"), phrase_in(asked["low"], anchor)),
        (F.lit("low_not_lower_lexical_overlap"), shared["high"] <= shared["low"]),
    ]
    for side, query in asked.items():
        lost = F.array_join(F.array_sort(F.array_except(numbers(said), numbers(query))), ",")
        checks.append((F.lit(f"{side}_not_question"), ~F.endswith(query, F.lit("?"))))
        checks.append((F.lit(f"{side}_copies_whole_evidence"), (flat != "") & F.contains(folded(one_line(query)), flat)))
        checks += [(F.lit(f"{side}_leaks_{name}"), wrong) for name, wrong in sorted(leak_columns(query, job).items())]
        checks.append((F.concat(F.lit(f"{side}_drops_numeric_constraint:"), lost), lost != ""))
    missing = (asked["high"] == "") | (asked["low"] == "") | (anchor == "")
    found = F.filter(F.array(*(F.when(wrong, name) for name, wrong in checks)), lambda e: e.isNotNull())
    return F.when(missing, F.array(F.lit("missing_or_non_string_query_or_anchor"))).otherwise(found)


def _rows(df: DataFrame, scope: str, key: Column, checks: Mapping[str, Column]) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())), lambda e: e.isNotNull())
    return df.select(F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.explode(found).alias("error"))


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def _times(text: str, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(F.col(text), F.col(part)))) / F.length(part)


def node_errors(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """(scope, key, error): passages of unknown sources, or whose content is not what stands at their place."""
    known = jobs.select(F.col("id").alias("job_id"), F.coalesce("description_clean", F.lit("")).alias("whole"))
    both = nodes.select("node_id", "job_id", "start_offset", "end_offset", "content_text").join(known, "job_id", "left")
    start, end = F.col("start_offset").cast("int"), F.col("end_offset").cast("int")
    there = (start >= 0) & (start < end) & (end <= F.length("whole")) & (F.substr("whole", start + 1, end - start) == F.col("content_text"))
    return _rows(both, "node", F.col("node_id"), {"unknown_source": F.col("whole").isNull(), "content_differs": F.col("whole").isNotNull() & ~F.coalesce(there, F.lit(False))})


def duplicates(df: DataFrame, scope: str, key: str) -> DataFrame:
    """(scope, key, error): keys that are empty or stand twice."""
    counted = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return _rows(counted, scope, F.col("key"), {"empty_key": F.col("key") == "", "duplicate_key": F.col("n") > 1})


def benchmark_errors(jobs: DataFrame, nodes: DataFrame, queries: DataFrame, qrels: DataFrame, expected_pairs: int | None = None, expected_per_family: int | None = None, families: tuple[str, ...] = ()) -> DataFrame:
    """(scope, key, error): everything that bars a benchmark from use."""
    spark = queries.sparkSession
    parts = [node_errors(nodes, jobs), duplicates(nodes, "node", "node_id"), duplicates(queries, "query", "query_id"), duplicates(qrels, "qrel", "query_id")]
    asked, judged = queries.select("query_id", F.lit(True).alias("asked")).distinct(), qrels.select("query_id", F.lit(True).alias("judged")).distinct()
    parts.append(_rows(asked.join(judged, "query_id", "full_outer"), "query", F.col("query_id"), {"no_qrel": F.col("judged").isNull(), "no_query": F.col("asked").isNull()}))
    parts.append(_rows(queries, "query", F.col("query_id"), {
        "unknown_kind": ~F.col("query_type").isin(*KINDS), "not_passed": F.col("validation_status") != "passed",
        "semantic": ~reduce(Column.__and__, (F.coalesce(F.col("semantic_validation")[f], F.lit(False)) for f in FLAGS)),
        "empty_question": F.trim(F.coalesce("query", F.lit(""))) == "",
    }))
    kinds = queries.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("query_type")).alias("kinds"))
    parts.append(_rows(kinds, "pair", F.col("pair_id"), {"empty_pair": F.coalesce("pair_id", F.lit("")) == "", "not_one_of_each_kind": (F.col("n") != 2) | (F.col("kinds") != F.array(*map(F.lit, sorted(KINDS))))}))
    side = lambda kind, names, mark: queries.where(F.col("query_type") == kind).select("pair_id", *(F.col(n).alias(f"{mark}{n}") for n in names))
    both = side(KINDS[0], (*SHARED, "query"), "").join(side(KINDS[1], (*SHARED, "query"), "low_"), "pair_id")
    parts.append(_rows(both, "pair", F.col("pair_id"), {f"sides_differ_{n}": _differ(n, f"low_{n}") for n in SHARED}))
    sources = both.groupBy("source_job_id").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rows(sources, "source", F.col("source_job_id"), {"chosen_twice": F.col("n") > 1}))
    about = jobs.select(F.col("id").alias("source_job_id"), "job_family", "company", "title", "url", F.col("source_job_id").alias("posting_id"), F.coalesce("description_clean", F.lit("")).alias("whole"))
    placed = both.join(about, "source_job_id", "left")
    parts.append(_rows(placed, "pair", F.col("pair_id"), {"unknown_source": F.col("whole").isNull(), "family_differs": F.col("whole").isNotNull() & _differ("source_job_family", "job_family")}))
    start, end = F.col("evidence_start").cast("int"), F.col("evidence_end").cast("int")
    within = (F.coalesce("evidence_text", F.lit("")) != "") & (start >= 0) & (start < end) & (end <= F.length("whole"))
    sound = placed.where("whole IS NOT NULL").withColumn("within", F.coalesce(within, F.lit(False)))
    exact = (F.substr("whole", start + 1, end - start) == F.col("evidence_text")) & (_times("whole", "evidence_text") == 1)
    parts.append(_rows(sound, "pair", F.col("pair_id"), {"invalid_place": ~F.col("within"), "not_once_at_place": F.col("within") & ~exact}))
    sound = sound.where("within").select("*", F.col("source_job_id").alias("job"), start.alias("start"), end.alias("end"))
    gold = enclosing(sound, nodes.select(F.col("job_id").alias("job"), "node_id", "start_offset", "end_offset"))
    parts.append(_rows(gold, "pair", F.col("pair_id"), {"no_passage": F.size("node_ids") == 0, "gold_differs": F.array_sort("evidence_node_ids") != F.col("node_ids")}))
    wanted = gold.select(F.col("pair_id").alias("wanted_pair"), F.col("source_job_id").alias("wanted_source"), F.col("node_ids").alias("wanted"))
    linked = queries.select("query_id", F.col("pair_id").alias("wanted_pair")).join(wanted, "wanted_pair").join(qrels.select("query_id", "pair_id", "source_job_id", "evidence_node_ids"), "query_id")
    parts.append(_rows(linked, "qrel", F.col("query_id"), {"pair_differs": _differ("pair_id", "wanted_pair"), "source_differs": _differ("source_job_id", "wanted_source"), "gold_differs": F.array_sort("evidence_node_ids") != F.col("wanted")}))
    job = {"company": F.col("company"), "title": F.col("title"), "id": F.col("source_job_id"), "source_job_id": F.col("posting_id"), "url": F.col("url")}
    worded = gold.select("pair_id", pair_error_column(F.col("query"), F.col("low_query"), F.col("anchor_term"), F.col("evidence_text"), job).alias("e"))
    parts.append(worded.select(F.lit("pair").alias("scope"), F.col("pair_id").alias("key"), F.explode("e").alias("error")))
    if expected_pairs is not None:
        parts.append(_rows(queries.agg(F.count_distinct("pair_id").alias("n")), "benchmark", F.col("n"), {f"expected_{expected_pairs}_pairs": F.col("n") != expected_pairs}))
    if expected_per_family is not None:
        parts.append(family_shortfall(both.select("source_job_family", "source_job_id"), expected_per_family, families or None))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "scope string, key string, error string")


def family_shortfall(sources: DataFrame, expected: int, families: tuple[str, ...] | None = None) -> DataFrame:
    """(scope, key, error): families whose number of distinct sources is not the expected one."""
    counted = sources.groupBy("source_job_family").agg(F.count_distinct("source_job_id").alias("n"))
    if families:
        every = sources.sparkSession.createDataFrame([(f,) for f in families], "source_job_family string")
        counted = every.join(counted, "source_job_family", "left").fillna(0, ["n"])
    return _rows(counted, "family", F.col("source_job_family"), {f"expected_{expected}_sources": F.col("n") != expected})


def ranking_errors(results: DataFrame, nodes: DataFrame, top_k: int) -> DataFrame:
    """(scope, key, error): rankings that are not ``top_k`` different passages that exist."""
    key = F.concat_ws("/", "query_id", "method")
    ranked = F.col("ranked_node_ids")
    sizes = _rows(results, "result", key, {"wrong_length": F.size(ranked) != top_k, "repeated_node": F.size(F.array_distinct(ranked)) != F.size(ranked)})
    listed = results.select(key.alias("key"), F.explode("ranked_node_ids").alias("node_id"))
    strange = listed.join(nodes.select("node_id").distinct(), "node_id", "left_anti").select("key").distinct()
    return sizes.union(strange.select(F.lit("result"), "key", F.lit("unknown_node")))


def require_valid(jobs: DataFrame, nodes: DataFrame, queries: DataFrame, qrels: DataFrame, **expected: Any) -> None:
    """Raises with the first errors of a benchmark, if it has any."""
    require_none(benchmark_errors(jobs, nodes, queries, qrels, **expected))

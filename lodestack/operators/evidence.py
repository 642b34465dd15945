"""Evidence: exact spans of a source text that state one fact of their own.

A span is a line, or a sentence of a long line. Gates are tried in order and the first
that closes gives the reason. Those that a text can answer itself, and those that need the
passages of its source, are tried where the text lies, in one Arrow pass; what the corpus has
in common (its frequent terms, spans that many sources repeat) is aggregated, and spans are not
exploded into their terms."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import TERM, evidence_terms, one_line, python_round
from lodestack.operators.batches import give_back, small_batches
from lodestack.storage import written

#: List marks, headings, ends of sentences, sections that say nothing of the role, and phrases of templates.
MARK = re.compile(r"\s*(?:[-*•]\s+|\d{1,2}[.)]\s+)")
HEADING = re.compile(r"\s*#{1,6}\s+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
OTHER_SECTIONS = ("about_company", "benefits", "additional_information")
OTHER_HEADING = (
    r"(?i)\b(?:benefits?|perks?|rewards?|compensation|salary|about us|about our company|equal opportunity|privacy|legal|"
    r"how to apply|application process|accommodation|diversity|life at)\b"
)
TEMPLATE = (
    r"\b(?:equal opportunity employer|reasonable accommodation|all qualified applicants|privacy policy|terms and conditions|"
    r"drug.free workplace|competitive salary|comprehensive benefits|401\s?\(?k\)?|paid time off|health insurance|"
    r"click (?:here|apply)|apply now|recruitment process|fast.paced environment|excellent communication skills|"
    r"strong communication skills|team player|passion for (?:our|the) mission)\b"
)
STATED_NUMBER, ANY_NUMBER = r"\b\d+(?:[.+%-]|\b)", r"\b\d"
CORE_SECTIONS = ("qualifications", "responsibilities")
#: Passages of the same words that many sources repeat are no evidence.
MOST_REPEATS = 3
LEAST_COMPANY = 3
#: Repeated passages up to this number are broadcast; beyond, joined by a shuffle.
BROADCAST_REPEATS = 200_000
#: Spans times characters up to which spans are searched for one by one.
SEARCHED = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PASS = 1 << 20
_TEMPLATE, _TERM = re.compile(TEMPLATE, re.I), re.compile(TERM)


@dataclass(frozen=True)
class Limits:
    min_chars: int = 40
    max_chars: int = 420
    min_words: int = 8
    max_words: int = 70
    max_document_frequency: float = 0.35

    def __post_init__(self) -> None:
        if not (0 < self.min_chars <= self.max_chars and 0 < self.min_words <= self.max_words and 0 < self.max_document_frequency <= 1):
            raise ValueError("limits of evidence are out of order")


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return start + len(part) - len(part.lstrip()), end - (len(part) - len(part.rstrip())) if part.strip() else start + len(part)


def span_ranges(text: str, max_chars: int) -> Iterator[tuple[int, int]]:
    """Lines without list marks, headings and blank ones left out; lines above ``max_chars`` by sentences."""
    for line in re.finditer(r"[^\n]+", text):
        start, end = _bare(text, *line.span())
        if HEADING.match(text[start:end]):
            continue
        if mark := MARK.match(text[start:end]):
            start, end = _bare(text, start + mark.end(), end)
        ends = list(SENTENCE_END.finditer(text, start, end)) if end - start > max_chars else []
        for a, b in zip([start, *(m.end() for m in ends)], [*(m.start() for m in ends), end], strict=True):
            a, b = _bare(text, a, b)
            if a < b:
                yield a, b


def stand_once(text: str, spans: list[tuple[int, int]]) -> list[bool]:
    """Of each span, whether its text stands only once in ``text``, not counting places that overlap the first.

    A few spans are searched for. Many are told by one pass: places that begin like any span (the hash of
    as many characters as the shortest has) are the only ones that can repeat one, and hashes of any length
    come from the same running sums. What a hash calls a repeat is compared."""
    longest = max((b - a for a, b in spans), default=0)
    if not longest:
        return [False] * len(spans)
    if len(spans) * len(text) <= SEARCHED:
        return [text.find(text[a:b], text.find(text[a:b]) + b - a) < 0 for a, b in spans]
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(letters), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers)])
    back = np.cumprod(np.full(len(letters), _INVERSE, np.uint64))
    hashes = lambda at, size: (sums[at + size] - sums[at]) * back[at]
    starts, sizes = (np.array(x, np.int64) for x in zip(*((a, b - a) for a, b in spans), strict=True))
    width = int(sizes.min())
    heads, label = np.unique(hashes(starts, width), return_inverse=True)
    every = np.concatenate([_labels(heads, hashes(np.arange(at, min(at + _PASS, len(letters) - width + 1)), width)) for at in range(0, len(letters) - width + 1, _PASS)])
    places = np.flatnonzero(every >= 0)
    places = places[np.argsort(every[places], kind="stable")]
    ends = np.searchsorted(every[places], np.arange(len(heads) + 1))
    once = np.ones(len(spans), bool)
    order = np.lexsort((sizes, label))
    for group in np.split(order, np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1):
        size, own = int(sizes[group[0]]), places[ends[label[group[0]]] : ends[label[group[0]] + 1]]
        own = own[own + size <= len(letters)]
        if len(own) < 2:
            continue
        values, which = np.unique(hashes(own, size), return_inverse=True)
        least, most = np.full(len(values), len(letters)), np.zeros(len(values), np.int64)
        np.minimum.at(least, which, own)
        np.maximum.at(most, which, own)
        at = np.searchsorted(values, hashes(starts[group], size))
        for k, first, last in zip(group[most[at] >= least[at] + size].tolist(), *(x[at][most[at] >= least[at] + size].tolist() for x in (least, most)), strict=True):
            a, b = spans[k]
            same = text.startswith(text[a:b], first) and text.startswith(text[a:b], last)
            once[k] = text.find(text[a:b], text.find(text[a:b]) + b - a) < 0 if not same else False
    return once.tolist()


def _labels(heads: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each hash among ``heads``, -1 where it is none of them."""
    at = np.minimum(np.searchsorted(heads, hashes), len(heads) - 1)
    return np.where(heads[at] == hashes, at, -1)


def local_gates(text: str, company: str | None, limits: Limits) -> Iterator[tuple[int, int, str, int, str | None]]:
    """(start, end, span, words, reason): the reason of the first gate that closes, of those that the text itself answers."""
    name = (company or "").strip()
    named = re.compile(rf"(?<!\w){re.escape(name)}(?!\w)", re.I) if len(name) >= LEAST_COMPANY else None
    told: list[tuple[int, int, str, int, str | None]] = []
    for a, b in span_ranges(text, limits.max_chars):
        span = text[a:b]
        words = len(_TERM.findall(span))
        if not limits.min_chars <= len(span) <= limits.max_chars:
            reason = "length_chars"
        elif not limits.min_words <= words <= limits.max_words:
            reason = "length_words"
        elif _TEMPLATE.search(span):
            reason = "template_or_non_role_fact"
        elif named and named.search(span):
            reason = "mentions_source_company"
        else:
            reason = None
        told.append((a, b, span, words, reason))
    once = iter(stand_once(text, [(a, b) for a, b, _, _, reason in told if reason is None]))
    seen: set[str] = set()
    for a, b, span, words, reason in told:
        if reason is None:
            normal = re.sub(r"\s+", " ", span).casefold()
            if not next(once) or normal in seen:
                reason = "ambiguous_or_duplicate_source_text"
            else:
                seen.add(normal)
        yield a, b, span, words, reason


class Passages:
    """The passages of one source, to be asked for those that hold all of a span."""

    def __init__(self, nodes: list[dict]) -> None:
        whole = (n for n in nodes if n["start_offset"] is not None and n["end_offset"] is not None and n["start_offset"] <= n["end_offset"])
        self.nodes = sorted(whole, key=self._order)
        self.starts = [n["start_offset"] for n in self.nodes]
        self.reach = list(accumulate((n["end_offset"] for n in self.nodes), max))

    @staticmethod
    def _order(node: dict) -> tuple:
        """As Spark orders structs of these: nulls first."""
        return (node["start_offset"], node["end_offset"], *((node[c] is not None, node[c] or "") for c in ("canonical_section", "section_heading")))

    def around(self, start: int, end: int) -> list[dict]:
        """In the order of their places; those before which none reaches ``end`` are not looked at."""
        found, at = [], bisect_right(self.starts, start) - 1
        while at >= 0 and self.reach[at] >= end:
            if self.nodes[at]["end_offset"] >= end:
                found.append(self.nodes[at])
            at -= 1
        return found[::-1]


_FIELDS = [("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("words", pa.int64()), ("reason", pa.string())]
_SPAN = "start:long,end:long,text:string,words:long,reason:string"
_NODES = ("node_id", "start_offset", "end_offset", "canonical_section", "section_heading")


def evidence_spans(jobs: DataFrame, limits: Limits = Limits(), id_col: str = "id", text_col: str = "description_clean", company_col: str = "company") -> DataFrame:  # noqa: B008
    """(job, start, end, text, words, reason) of all spans; null texts have none."""
    small_batches(jobs.sparkSession)

    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, companies in pairs:
            rows = ([dict(zip((n for n, _ in _FIELDS), s, strict=True)) for s in local_gates(t or "", c, limits)] for t, c in zip(texts.to_pylist(), companies.to_pylist(), strict=True))
            yield pa.array(list(rows), pa.list_(pa.struct(_FIELDS)))
        give_back()

    run.__annotations__ = {"pairs": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, f"array<struct<{_SPAN}>>")(F.col(text_col).cast("string"), F.col(company_col).cast("string"))
    return jobs.select(F.col(id_col).alias("job"), F.explode(found).alias("s")).select("job", "s.*")


def placed_spans(jobs: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``evidence_spans`` with source_job_family, node_ids, canonical_section and section_heading: of an open span all passages that hold it, and the section of the first.

    A source's text meets its passages once; null sources have none."""
    small_batches(jobs.sparkSession)
    own = nodes.where(F.col("job_id").isNotNull()).groupBy(F.col("job_id").alias("_job")).agg(F.collect_list(F.struct(*(F.col(c) for c in _NODES))).alias("_nodes"))
    texts = jobs.select(F.col("id").alias("job"), F.col("description_clean").cast("string").alias("_text"), F.col("company").cast("string").alias("_company"), F.col("job_family").alias("source_job_family"))
    fields = [*_FIELDS, ("node_ids", pa.list_(pa.string())), ("canonical_section", pa.string()), ("section_heading", pa.string())]

    def told(text: str | None, company: str | None, held: list[dict] | None) -> list[dict]:
        around, out = Passages(held or []), []
        for span in local_gates(text or "", company, limits):
            row = dict(zip((n for n, _ in _FIELDS), span, strict=True))
            if row["reason"] is None:
                found = around.around(row["start"], row["end"])
                first = found[0] if found else {}
                row |= {"node_ids": sorted({n["node_id"] for n in found} - {None}), "canonical_section": first.get("canonical_section"), "section_heading": first.get("section_heading")}
            out.append(row)
        return out

    def run(rows: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in rows:
            yield pa.array([told(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.list_(pa.struct(fields)))
        give_back()

    run.__annotations__ = {"rows": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, f"array<struct<{_SPAN},node_ids:array<string>,canonical_section:string,section_heading:string>>")("_text", "_company", "_nodes")
    return texts.join(own, F.col("job") == F.col("_job"), "left").select("job", "source_job_family", F.explode(found).alias("s")).select("job", "source_job_family", "s.*")


def document_frequency(jobs: DataFrame, text_col: str = "description_clean") -> DataFrame:
    """(term, df): in how many texts each term stands."""
    return jobs.select(F.explode(evidence_terms(text_col)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def evidence_rows(jobs: DataFrame, nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Every span with its final reason (null where it is accepted) and what a candidate needs.

    ``jobs``: (id, job_family, company, description_clean); ``nodes``: passages of them with job_id."""
    n_jobs, none = max(1, jobs.count()), F.array().cast("array<string>")
    spans = written(placed_spans(jobs, nodes, limits), "spans")
    # terms above the limit are few: their documents have 1 / max_document_frequency of them each, on average
    frequent = document_frequency(jobs).where(F.col("df") / n_jobs > limits.max_document_frequency).agg(F.collect_list("term").alias("frequent"))
    section = F.coalesce(F.nullif("canonical_section", F.lit("")), F.lit("unsectioned"))
    held = spans.where("reason IS NULL").crossJoin(F.broadcast(frequent)).select(
        "job", "source_job_family", "start", "end", "text", "words", "node_ids", section.alias("section"), F.coalesce("section_heading", F.lit("")).alias("heading"),
        F.array_sort(F.array_except(evidence_terms("text"), "frequent")).alias("distinctive_terms"), F.unhex(F.md5(F.lower(one_line("text")).cast("binary"))).alias("alike"),
    )
    other = F.col("section").isin(*OTHER_SECTIONS) | (F.col("section").isin("unsectioned", "unmapped") & F.col("heading").rlike(OTHER_HEADING))
    reason = (
        F.when(F.size("node_ids") == 0, "no_complete_node").when(other, "non_role_section")
        .when((F.size("distinctive_terms") == 0) & ~F.col("text").rlike(STATED_NUMBER), "generic_corpus_vocabulary")
    )
    held = written(held.withColumn("reason", reason), "open-spans")
    repeated = held.where("reason IS NULL").groupBy("alike").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_REPEATS).select("alike", F.lit("repeated_across_jobs").alias("often"))
    repeated = written(repeated, "repeated")
    held = held.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_REPEATS else repeated, "alike", "left").withColumn("reason", F.coalesce("reason", "often"))
    score = F.size("distinctive_terms") / F.greatest(F.sqrt("words"), F.lit(1.0)) + F.when(F.col("text").rlike(ANY_NUMBER), 1.0).otherwise(0.0) + F.when(F.col("section").isin(*CORE_SECTIONS), 0.5).otherwise(0.0)
    columns = ("job", "source_job_family", "start", "end", "text", "words", "reason")
    extra = {"node_ids": none, "section": F.lit(""), "heading": F.lit(""), "distinctive_terms": none, "score": F.lit(0.0)}
    closed = spans.where("reason IS NOT NULL").select(*columns, *(F.when(F.lit(False), kind).alias(c) for c, kind in extra.items()))
    return closed.union(held.select(*columns, *list(extra)[:-1], python_round(score, 3).alias("score")))


def evidence_candidates(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """The accepted spans as candidates, by family, source and place."""
    key = F.concat_ws("\u001f", F.col("job").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "text")
    if "source_job_family" not in rows.columns:  # rows that were not made by evidence_rows
        rows = rows.join(jobs.select(F.col("id").alias("job"), F.col("job_family").alias("source_job_family")), "job")
    return rows.where("reason IS NULL").orderBy("source_job_family", "job", "start").select(
        F.substring(F.sha2(key, 256), 1, 20).alias("candidate_id"), F.col("job").alias("source_job_id"), "source_job_family", F.col("text").alias("evidence_text"),
        F.col("start").alias("evidence_start"), F.col("end").alias("evidence_end"), F.col("node_ids").alias("evidence_node_ids"),
        F.nullif("heading", F.lit("")).alias("section_heading"), F.col("section").alias("canonical_section"), "distinctive_terms", F.col("score").alias("distinctiveness_score"),
    )


def evidence_rejections(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select(F.col("job").alias("source_job_id"), F.col("start").alias("evidence_start"), F.col("end").alias("evidence_end"), F.col("text").alias("evidence_text"), "reason")


def evidence_counts(rows: DataFrame) -> DataFrame:
    """(outcome, spans): how many spans were accepted, or rejected for which reason."""
    outcome = F.coalesce(F.concat(F.lit("rejected_"), F.col("reason")), F.lit("accepted_candidates"))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("spans"))

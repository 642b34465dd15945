"""Plug-ins for models: a pair generator over any text completion, and short checks that a model works at all."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np

from lodestack.operators.build import PairGenerator, ask
from lodestack.operators.dense import Embedder
from lodestack.operators.retrieval import PairScorer

#: Instructions that ask for a pair and for a judgment; their versions go into what is built with them.
PROMPT_VERSION, JUDGE_VERSION = "pairs-1", "judge-1"
WRITE_PAIR = (
    "You get one piece of evidence from a saved job description, as data. Write two English questions that ask which saved role has this one requirement or duty. "
    "Keep every number, comparison, negation and technical condition in both. Choose as anchor_term a distinctive term of one to three words that stands in the evidence. "
    "high_query contains it; low_query says the same in other words without it. Name no company, title, link or identifier, do not copy the evidence whole, and end both with a question mark. "
    'Answer with one JSON object with the keys high_query, low_query and anchor_term, or with {} if the evidence is vague.'
)
JUDGE_PAIR = (
    "You get evidence and two questions about it, as data. Judge them on their own. Answer with one JSON object: booleans role_related_atomic_fact, self_contained_evidence, "
    "same_information_need, high_supported, low_supported, constraints_preserved, natural_questions and low_is_conceptual_paraphrase, each true only if there is no doubt, and a short text reason."
)
#: What a working model must tell apart.
EVIDENCE = "At least 3 years of experience deploying machine-learning services on Kubernetes."
SOURCE = {"id": "smoke-source", "company": "Sample Company", "title": "ML Engineer", "url": "https://example.org/smoke"}
UNRELATED = "Design product roadmaps and pricing."
RERANK_CHECK = (("Which role uses Kubernetes?", "The role requires Kubernetes experience."), ("Which role uses Kubernetes?", "The role plans retail pricing."))
_SHOWN = 300


def read_answer(text: str) -> dict[str, Any]:
    """The JSON object of an answer, bare or inside one fenced block; ValueError where there is none."""
    bare = text.strip()
    if fenced := re.fullmatch(r"```(?:json)?(.*)```", bare, re.S):
        bare = fenced[1].strip()
    try:
        value = json.loads(bare)
    except json.JSONDecodeError as error:
        raise ValueError(f"no JSON object: {bare[:_SHOWN]!r}") from error
    if not isinstance(value, dict):
        raise ValueError(f"JSON, but no object: {bare[:_SHOWN]!r}")
    return value


class JsonGenerator:
    """A pair generator from ``complete(instructions, content) -> text``. What a source says goes in as quoted data."""

    def __init__(self, complete: Callable[[str, str], str], name: str, revision: str | None = None, write: str = WRITE_PAIR, judge: str = JUDGE_PAIR):
        self.complete, self.name, self.revision, self.write, self.judge = complete, name, revision, write, judge

    def generate_pair(self, evidence_text: str, *, rejection_reason: str | None = None) -> Mapping[str, Any]:
        content = {"evidence": evidence_text} | ({"last_attempt_failed": rejection_reason[:_SHOWN]} if rejection_reason else {})
        return read_answer(self.complete(self.write, json.dumps(content, ensure_ascii=False)))

    def validate_pair(self, evidence_text: str, high_query: str, low_query: str, anchor_term: str) -> Mapping[str, Any]:
        content = {"evidence": evidence_text, "high_query": high_query, "low_query": low_query, "anchor_term": anchor_term}
        return read_answer(self.complete(self.judge, json.dumps(content, ensure_ascii=False)))


def loaded(name: str) -> Callable[[], Any]:
    """The factory ``module:name`` of a model."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def check_generator(generator: PairGenerator, attempts: int = 3) -> Mapping[str, Any]:
    """A pair for known evidence; raises where none is accepted."""
    pair, rejected = ask(generator, EVIDENCE, SOURCE, attempts)
    if pair is None:
        raise ValueError(f"no pair in {attempts} attempts: {rejected}")
    return pair


def check_embedder(embedder: Embedder, question: str = "Which role needs years of running services on a container platform?") -> None:
    """Raises unless the known evidence is nearer to a question about it than an unrelated text."""
    vectors = np.asarray(embedder.encode([question, EVIDENCE, UNRELATED]), float)
    lengths = np.linalg.norm(vectors, axis=1)
    if vectors.shape[0] != 3 or not np.isfinite(vectors).all() or not lengths.all():
        raise ValueError("vectors are missing, not finite or zero")
    unit = vectors / lengths[:, None]
    if unit[0] @ unit[1] <= unit[0] @ unit[2]:
        raise ValueError("an unrelated text is nearer than the evidence")


def check_scorer(scorer: PairScorer) -> None:
    """Raises unless an answer scores above an unrelated text."""
    scores = [float(s) for s in scorer.compute_score(list(RERANK_CHECK))]
    if len(scores) != 2 or not np.isfinite(scores).all() or scores[0] <= scores[1]:
        raise ValueError(f"an unrelated text scores as high as an answer: {scores}")

"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents and invisible characters, maps look-alike letters of
other scripts and of styled alphabets to Latin ones, and reads digits and signs next to
letters as the letters they stand for. The lexicon holds whole words and word beginnings
of labelled documents whose share of toxic holders is beyond chance; a weight is a
smoothed log-odds. A hit
inside an exception phrase (a two-word phrase seen in clean documents only) does not
count. The weights' sum and its share of the text's length go through a logistic curve.

The model is fitted on about ``per_class`` labelled documents of each class at most (chosen by
hash); scoring covers every whole text. Defined results: null and empty texts have no
hits and get the curve's value at zero. Extra columns are ignored or passed through.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import fold_of, picked_rows, sigmoid, text_udf

PER_CLASS = 2500
#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ո": "n", "ս": "u", "ѵ": "v", "ѡ": "w", "ɩ": "i", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
#: Signs read as letters where they touch a letter.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e"}
#: Read as letters only between two letters.
BETWEEN = {"!": "i", "|": "l", "+": "t"}
_NEXT_TO = re.compile("(?<=[a-z])[0134578-9@$€]+(?![0-9])|(?<![0-9@$€])[0134578-9@$€]+(?=[a-z])")
_BETWEEN = re.compile(r"(?<=[a-z])[!|+](?=[a-z])")
_MAYBE = re.compile("[0-9@$€!|+]")
_WORDS = re.compile(r"[^\W\d_]+")
_RANGES = ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x2460, 0x2500), (0xFF00, 0xFF5F), (0x1D400, 0x1D7CC))


def _table() -> dict[int, str | None]:
    """Base letters of accented and styled ones, look-alikes, and nothing for invisible characters."""
    table: dict[int, str | None] = {}
    for low, high in _RANGES:
        for code in range(low, high):
            base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
            if base.isascii() and base.isalpha():
                table[code] = base
    table |= {ord(k): v for k, v in LOOKALIKES.items()}
    table |= {ord(k.upper()): v for k, v in LOOKALIKES.items() if len(k.upper()) == 1 and not k.upper().isascii()}
    return table | dict.fromkeys([*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])


_TABLE = _table()


def fold(text: str) -> str:
    low = text.lower()
    if not low.isascii():
        low = low.translate(_TABLE)
    if _MAYBE.search(low):
        low = _NEXT_TO.sub(lambda m: "".join(map(SIGNS.get, m[0])), low)
        low = _BETWEEN.sub(lambda m: BETWEEN[m[0]], low)
    return low


@dataclass
class Lexicon:
    """``words`` match whole, ``starts`` at a word's beginning; ``exceptions`` are two-word phrases."""

    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        entries: dict[str, list[tuple[str, int, float]]] = {}
        for kind, items in (("w", self.words), ("s", self.starts), ("x", dict.fromkeys(self.exceptions, 0.0))):
            for text, weight in items.items():
                entries.setdefault(text, []).append((kind, len(text), weight))
        for text, what in entries.items():
            found.add_word(text, what)
        found.make_automaton()
        return found if entries else None


def matches(automaton, folded: str) -> float:
    """Sum of the weights of hits outside exception phrases; a word counts once, by its heaviest entry."""
    if automaton is None:
        return 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    size = len(folded)
    for end, entries in automaton.iter(folded):
        for kind, length, weight in entries:
            start = end - length + 1
            if start and folded[start - 1].isalpha():
                continue
            if kind != "s" and end + 1 < size and folded[end + 1].isalpha():
                continue
            if kind == "x":
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
    for low, high in spared:
        for start in [s for s in hits if low <= s <= high]:
            del hits[start]
    return sum(hits.values())


def measures(automaton, text: str | None) -> tuple[float, float]:
    """(log of one plus the weight, log of one plus the weight per hundred words)."""
    if not text:
        return 0.0, 0.0
    weight = matches(automaton, fold(text))
    words = len(text.split())
    return float(np.log1p(weight)), float(np.log1p(100.0 * weight / (words + 20)))


def _entries(words: set[str]) -> set[str]:
    """Whole words as ``word$``, and beginnings of 4 to 8 letters."""
    return {w + "$" for w in words if len(w) >= 3} | {w[:k] for w in words for k in range(4, 9) if len(w) >= k}


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[list[str], int]]:
    """Folded words of the texts, without those that share a smallest four-word hash with an earlier one."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in rows:
        words = _WORDS.findall(fold(text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)
        keys = {(k, int(((hashes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))}
        if not keys & seen:
            out.append((words, int(label)))
        seen |= keys
    return out


def fit_lexicon(rows: list[tuple[str, int]], prior: float | None = None, chance: float = 0.01, least_odds: float = 3.0) -> Lexicon:
    """Entries whose holders are toxic too often for chance, the strongest evidence first; no entry begins with another.

    ``chance`` bounds the expected number of entries found by accident; near copies count once."""
    docs = _without_copies(rows)
    in_toxic: Counter[str] = Counter()
    for words, label in docs:
        if label:
            in_toxic.update(_entries(set(words)))
    n_toxic = max(1, sum(y for _, y in docs))
    in_toxic = Counter({e: n for e, n in in_toxic.items() if n >= 4})
    in_clean = Counter(e for w, y in docs if not y for e in _entries(set(w)) & in_toxic.keys())
    n_clean = max(1, len(docs) - n_toxic)
    share = n_toxic / (n_toxic + n_clean)
    bar = float(np.log(max(1, len(in_toxic)) / chance))

    def evidence(e: str) -> float:
        """Log-likelihood ratio of the entry's toxic share against the sample's."""
        t, c = in_toxic[e], in_clean[e]
        if t < 4 or t * n_clean < least_odds * c * n_toxic:
            return 0.0
        return t * np.log(t / ((t + c) * share)) + (c * np.log(c / ((t + c) * (1 - share))) if c else 0.0)

    strength = {e: v for e in in_toxic if (v := evidence(e)) > bar}
    lexicon, bodies = Lexicon(), set()

    def narrow(e: str) -> bool:
        """A whole word about as strong as each of its beginnings."""
        return e.endswith("$") and all(strength[e] >= 0.9 * strength.get(e[:k], 0) for k in range(4, len(e)))

    for e in sorted(strength, key=lambda e: (not narrow(e), -strength[e], e)):
        body = e.rstrip("$")
        if any(body[:k] in lexicon.starts for k in range(4, len(body) + 1)) or body in bodies:
            continue
        bodies.update(body[:k] for k in range(4, len(body) + 1))
        weight = np.log((in_toxic[e] + 0.5) / (n_toxic + 1)) - np.log((in_clean[e] + 0.5) / (n_clean + 1))
        (lexicon.words if e.endswith("$") else lexicon.starts)[body] = float(weight)
    lexicon.exceptions = _exceptions(docs, lexicon)
    machine = lexicon.automaton()
    x = np.array([measures(machine, " ".join(w)) for w, _ in docs] or [(0.0, 0.0)])
    y = np.array([y for _, y in docs] or [0], float)
    rate = y.mean() if prior is None else prior
    weights = np.where(y > 0, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    lexicon.curve = fit_curve(x, y, weights)
    return lexicon


def _exceptions(docs: list[tuple[list[str], int]], lexicon: Lexicon) -> set[str]:
    """Two-word phrases around a hit that only clean texts hold, three of them at least."""
    counts: dict[str, list[int]] = {}
    starts = tuple(lexicon.starts)
    for words, label in docs:
        found = set()
        for i, w in enumerate(words):
            if w in lexicon.words or (starts and w.startswith(starts)):
                found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
        for phrase in found:
            counts.setdefault(phrase, [0, 0])[label] += 1
    return {p for p, (clean, toxic) in counts.items() if clean >= 3 and not toxic}


def fit_curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    full = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(full.shape[1])
    for _ in range(30):
        p = sigmoid(full @ beta)
        gradient = full.T @ (weights * (y - p)) / len(y) - ridge * np.array([0.0, *beta[1:]]) / 10
        curvature = (full * (weights * p * (1 - p))[:, None]).T @ full / len(y) + ridge / 10 * np.eye(full.shape[1])
        step = np.linalg.solve(curvature, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(b) for b in beta)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Fit on a bounded sample; only the sample's ids are broadcast (2 * ``per_class`` at most)."""
    picked = picked_rows(labels, id_col, label_col, held_out, per_class)
    shares = labels.where(~held_out & F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    rows = documents.select(F.col(id_col).alias("picked_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "picked_id")
    return fit_lexicon([(r[0] or "", int(r[1])) for r in rows.select("text", "label").collect()], shares)


def toxicity_of(text: Column, lexicon: Lexicon) -> Column:
    """The score (0 to 1) of a text column."""

    def make():
        machine, (bias, a, b) = lexicon.automaton(), lexicon.curve

        def each(texts: list) -> list:
            x = np.array([measures(machine, t) for t in texts]).reshape(-1, 2)
            return sigmoid(bias + a * x[:, 0] + b * x[:, 1]).tolist()

        return each

    return text_udf(make, "double", pa.float64())(text)


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(fold_of(id_col, 5) == 0, F.lit(False))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity_of(F.col("text"), lexicon).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

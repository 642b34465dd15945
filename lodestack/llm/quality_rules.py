"""Quality rules: counts with fixed limits, then a calibrated linear model of hashed n-grams.

Every text is measured (words, characters of words, symbols, repeated lines, words in
repeated windows of three) and fails the base rules when it is short or mostly repeats.
The rest is told by a logistic regression of hashed word and character n-grams: logarithms
of counts in ``BUCKETS`` buckets, half for byte n-grams and half for words and pairs of
words, each half of length one. Texts are read in pieces of ``PIECE`` bytes, so the
memory for n-grams does not grow with them.

The regression is fitted by Spark on at most about ``per_class`` labelled documents of
each class, chosen by hash; their features stay in a written table, and only gradients
and margins reach the driver. A fifth of them is not fitted but calibrates: a logistic
curve of the margin, weighted to the shares of the classes among all labelled rows. A
text is kept at a probability of ``LEAST_GOOD`` or more.

Defined results: null and empty texts have zero counts and fail the base rules. Without
labels of both classes the probability is the share of good ones, without any it is one
half. A document with several labels has the largest. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, fold_of, free_name, picked_rows, sigmoid, text_udf, written

PER_CLASS = 3_000
BUCKETS = 1 << 15
LEAST_GOOD = 0.5
MIN_WORDS, MOST_REPEATED = 50, 50
PIECE = 1 << 20
_HALF = BUCKETS // 2
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_SIZES = (1, 2, 3, 4)
_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_TASKS = 32

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_numbers(raw: bytes) -> tuple[np.ndarray, dict[bytes, int]]:
    """The words of a text as numbers in the order of their first places, and these words."""
    known: dict[bytes, int] = {}
    words = raw.split()
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), known


def repeated_words(numbers: np.ndarray, n_known: int) -> int:
    """Words that stand in any window of three which the text holds twice or more."""
    if len(numbers) < 3:
        return 0
    pairs = numbers[:-2] * n_known + numbers[1:-1]
    if n_known >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs * n_known + numbers[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts_of(text: str | None, raw: bytes, numbers: np.ndarray, n_known: int) -> tuple[int, ...]:
    """The five counts, in the order of ``COUNTS``."""
    lines = [x for x in raw.split(b"\n") if x.strip()]
    blanks = len(raw) - len(raw.translate(None, _BLANKS))
    return len(numbers), len(text or "") - blanks, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(numbers, n_known)


def _places(hashes: np.ndarray, first: int) -> np.ndarray:
    return (((hashes * _MIX) >> np.uint64(40)) % np.uint64(_HALF)).astype(np.int64) + first


def hashed(raw: bytes, numbers: np.ndarray, known: dict[bytes, int]) -> np.ndarray:
    """Logarithms of the counts of byte n-grams and of words and pairs, hashed; each half has length one."""
    found = np.zeros(BUCKETS)
    lower = raw.lower()
    for start in range(0, len(lower), PIECE):
        letters = np.frombuffer(lower[start : start + PIECE + max(_SIZES) - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        hashes = np.zeros(len(letters), np.uint64)
        for size in _SIZES:
            hashes = hashes[: len(letters) - size + 1] * _STEP + letters[size - 1 :]
            found[:_HALF] += np.bincount(_places(hashes[:PIECE], 0), minlength=_HALF)[:_HALF]
    own = np.fromiter((zlib.crc32(w.lower()) for w in known), np.uint64, len(known))
    for start in range(0, len(numbers), PIECE):
        hashes = own[numbers[start : start + PIECE + 1]]
        found += np.bincount(_places(hashes[:PIECE], _HALF), minlength=BUCKETS)
        found += np.bincount(_places(hashes[:-1] * _STEP + hashes[1:] + np.uint64(1), _HALF), minlength=BUCKETS)
    found = np.log1p(found).reshape(2, _HALF)
    return (found / np.maximum(np.sqrt((found**2).sum(1, keepdims=True)), 1e-12)).ravel()


@dataclass
class Rules:
    """Weights of the buckets, their constant, and the curve from margins to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, features: np.ndarray) -> float:
        return float(sigmoid(self.slope * (features @ self.weights + self.bias) + self.shift))


def calibrated(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the labels best, by Newton's method; targets are drawn in from 0 and 1."""
    n_good, n_bad = labels.sum(), (1 - labels).sum()
    wanted = np.where(labels > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x, at = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((weights * (np.logaddexp(0, z) - wanted * z)).sum())

    for _ in range(steps):
        p = sigmoid(x @ at)
        slope = x.T @ (weights * (p - wanted))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), slope)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _features(texts: list) -> list:
    out = []
    for text in texts:
        raw = (text or "").encode()
        found = hashed(raw, *word_numbers(raw))
        used = np.flatnonzero(found)
        out.append((used.astype(np.int32), found[used]))
    return out


_sparse = F.udf(lambda x: Vectors.sparse(BUCKETS, x["at"], x["value"]), VectorUDT())


def train(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Rules:
    """Fits and calibrates on labelled rows outside ``held_out``."""
    share = labels.where(~held_out & F.col(label_col).isNotNull()).agg(F.avg((F.col(label_col) >= 1).cast("double"))).first()[0]
    unknown = Rules(np.zeros(BUCKETS), 0.0 if share is None else float(np.log(np.clip(share, 0.01, 0.99) / np.clip(1 - share, 0.01, 0.99))))
    if share in (None, 0.0, 1.0):
        return unknown
    spark, bag = documents.sparkSession, []
    picked = F.broadcast(picked_rows(labels, id_col, label_col, held_out, per_class))
    rows = documents.select(F.col(id_col).alias("picked_id"), F.col(text_col).alias("text")).join(picked, "picked_id").repartition(_TASKS, "picked_id")
    kind = pa.struct([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])
    measured = text_udf(lambda: _features, "struct<at: array<int>, value: array<double>>", kind)
    good = (F.col("label") >= 1).cast("double")
    rows = written(rows.select((F.pmod(F.xxhash64(F.lit(5), "picked_id"), F.lit(5)) == 0).alias("calibrates"), good.alias("label"), measured(F.col("text")).alias("x")), "quality-features", bag=bag)
    try:
        sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("calibrates", "label").agg(F.count(F.lit(1))).collect()}
        if len(sizes) < 4:
            return unknown
        weight = lambda calibrates: F.when(F.col("label") == 1, share / sizes[calibrates, 1.0]).otherwise((1 - share) / sizes[calibrates, 0.0]) * sum(n for k, n in sizes.items() if k[0] == calibrates)
        fitted = rows.where("not calibrates").select("label", weight(False).alias("weight"), _sparse("x").alias("features"))
        model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=40, standardization=False, aggregationDepth=2).fit(fitted)
        rules = Rules(np.asarray(model.coefficients.toArray()), float(model.intercept))
        told = model.transform(rows.where("calibrates").select("label", weight(True).alias("weight"), _sparse("x").alias("features")))
        got = told.select(vector_to_array("rawPrediction")[1].alias("margin"), "label", "weight").collect()
    finally:
        discard(spark, bag)
    rules.slope, rules.shift = calibrated(*(np.array([r[k] for r in got], float) for k in ("margin", "label", "weight")))
    return rules


def judged(text: Column, rules: Rules) -> Column:
    """A structure of the five counts and the probability that the text is good."""

    def make():
        def each(texts: list) -> list:
            out = []
            for text in texts:
                raw = (text or "").encode()
                numbers, known = word_numbers(raw)
                out.append((*counts_of(text, raw, numbers, len(known)), rules.probability(hashed(raw, numbers, known))))
            return out

        return each

    kind = pa.struct([*((name, pa.int64()) for name in COUNTS), ("probability", pa.float64())])
    return text_udf(make, "struct<" + ", ".join(f"{name}: bigint" for name in COUNTS) + ", probability: double>", kind)(text)


def quality_rules(df: DataFrame, rules: Rules, text_col: str = "text", least_good: float = LEAST_GOOD) -> DataFrame:
    """``df`` with the five counts, ``base_failed``, ``kept`` and ``probability``; columns of ``df`` of these names are replaced."""
    found = free_name(df, "found")
    names = (*COUNTS, "base_failed", "kept", "probability")
    rows = df.withColumn(found, judged(F.col(text_col), rules))
    n = F.col(found)
    short, repeats = n["n_words"] < MIN_WORDS, 100 * n["n_repeat_words"] > MOST_REPEATED * n["n_words"]
    made = {**{name: n[name] for name in COUNTS}, "base_failed": short | repeats, "kept": ~(short | repeats) & (n["probability"] >= least_good), "probability": n["probability"]}
    return rows.select(*(F.col(c) for c in df.columns if c.lower() not in names), *(made[name].alias(name) for name in names))


def held_out(id_col: str | Column) -> Column:
    """The rows that op8_quality does not learn from are not learned from here either."""
    return F.coalesce(fold_of(id_col, 4) == 2, F.lit(False))


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id"))
    return quality_rules(docs.select("doc_id", "text"), rules).drop("text")

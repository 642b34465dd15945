"""Quality: histogram gradient-boosted trees over document statistics.

A document becomes two dozen statistics of its bytes, words and lines. Trees are grown
leaf by leaf on binned statistics with second-order gains, then flattened into arrays;
scoring walks all rows of a batch through each tree level with numpy.

Fitted on about ``per_class`` labelled documents of each class at most (by hash; only
their statistics reach the driver); scoring covers every whole text. Defined results:
null and empty texts have all-zero statistics and get the trees' value there. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import fold_of, picked_rows, sigmoid, text_udf

PER_CLASS = 15_000
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b"#$%&*@^~", b"|<>{}[]=_\\/", b".,;:", b"\"'()-", b"\n", b" \t",
)


def _class_matrix() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, members in enumerate(_CLASSES):
        table[list(members), k] = 1
    table[0xC0:, -1] = 1
    return table


_MATRIX = _class_matrix()
N_FEATURES = len(_CLASSES) + 1 + 16


def statistics(text: str | None) -> list[float]:
    """Shares of byte classes, then lengths, repetition and spread of words and lines."""
    if not text:
        return [0.0] * N_FEATURES
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    histogram = np.bincount(raw, minlength=256)
    shares = histogram / len(raw)
    used = shares[shares > 0]
    words = text.split()
    n = len(words) or 1
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = len(lines) or 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = set(zip(words, words[1:], strict=False))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, counts))
    return [
        *(shares @ _MATRIX).tolist(),
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(pairs) / n,
        repeats / n,
        len(set(lines)) / n_lines,
        float(np.log1p(n / n_lines)),
        float(-(used * np.log2(used)).sum()),
        upper / max(1, len(counts)),
        float((sizes <= 2).mean()),
        float((sizes >= 12).mean()),
        len(text) / len(raw),
    ]


@dataclass
class Trees:
    """All trees in flat arrays: a node's children are at ``left`` and ``left + 1``; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.left[at] > 0
                at = np.where(inner, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]), at)
            total += self.value[at]
        return sigmoid(total)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 3.0, weights: np.ndarray | None = None) -> Trees:
    """Second-order boosting of the logistic loss on histograms, level by level."""
    weights = np.ones(len(y)) if weights is None else weights
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64) if len(x) else np.zeros((0, n_features), np.int64)
    share = float(np.clip((weights * y).sum() / max(weights.sum(), 1e-9), 0.01, 0.99)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(y), bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for column in (feature, left):
            column.append(0)
        for column in (threshold, value):
            column.append(0.0)
        return len(value) - 1

    columns = np.arange(n_features) * bins
    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = sigmoid(margin)
        g, h = weights * (p - y), weights * p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for k, rows in open_nodes:
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                split = None
                if level < depth and sum_h >= 2 * least:
                    flat = (binned[rows] + columns).ravel()
                    hist_g = np.bincount(flat, np.repeat(g[rows], n_features), n_features * bins).reshape(n_features, bins).cumsum(1)
                    hist_h = np.bincount(flat, np.repeat(h[rows], n_features), n_features * bins).reshape(n_features, bins).cumsum(1)
                    gain = hist_g**2 / (hist_h + ridge) + (sum_g - hist_g) ** 2 / (sum_h - hist_h + ridge) - sum_g**2 / (sum_h + ridge)
                    gain[(hist_h < least) | (sum_h - hist_h < least)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-3 and b < len(edges[f]):
                        split = int(f), int(b)
                if split is None:
                    value[k] = float(-rate * sum_g / (sum_h + ridge))
                    margin[rows] += value[k]
                    continue
                f, b = split
                feature[k], threshold[k] = f, float(edges[f][b])
                left[k] = node()
                node()
                right = binned[rows, f] > b
                following += [(left[k], rows[~right]), (left[k] + 1, rows[right])]
            open_nodes = following
    return Trees(*(np.array(c) for c in (feature or [0], threshold or [0.0], left or [0], value or [0.0])), np.array(roots, int), depth, bias)


def train(documents: DataFrame, labels: DataFrame, held_out: Column, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    picked = picked_rows(labels, id_col, label_col, held_out, per_class)
    share = labels.where(~held_out & F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.5
    rows = documents.select(F.col(id_col).alias("picked_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "picked_id")
    measured = text_udf(lambda: lambda texts: [statistics(t) for t in texts], "array<double>", pa.list_(pa.float64()))
    got = rows.select("label", measured(F.col("text")).alias("x")).collect()
    x, y = np.array([r["x"] for r in got]).reshape(len(got), N_FEATURES), np.array([float(r["label"]) for r in got])
    mean = y.mean() if len(y) else 0.5
    weights = np.where(y > 0, share / max(mean, 1e-9), (1 - share) / max(1 - mean, 1e-9))
    return fit_trees(x, y, weights=weights)


def quality_of(text: Column, trees: Trees) -> Column:
    def make():
        return lambda texts: trees.score(np.array([statistics(t) for t in texts]).reshape(len(texts), N_FEATURES)).tolist()

    return text_udf(make, "double", pa.float64())(text)


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(fold_of(id_col, 4) == 2, F.lit(False))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out("doc_id"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_of(F.col("text"), trees).alias("score"))
    return scored.select("*", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))

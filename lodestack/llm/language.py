"""Language identification of words in code-switched text by a linear-chain CRF.

Every word has a score for each language: a sum of learned weights of its hashed
features (beginnings, endings, letter pairs and triples, and the word itself where it is
in the lexicon of frequent words). A word is a whole run of letters, however long: without
spaces, a clause. Learned transitions couple neighbours, and
forward-backward gives each word's marginals. A document's language is that with the
largest mean marginal; the mean is its score.

Forward-backward runs over blocks of ``BLOCK`` words: a matrix product for each block,
a scan over the blocks of a document, then all blocks together inside. That is exact,
and a text of any length costs as many numpy calls as a short one, but for the scan.

Fitted on about ``per_language`` labelled documents of each language at most (chosen by hash),
cut into windows, half of which splice two documents so that switches are learned; every
word of a sampled text is in some window. Defined results: ``und`` with score 0 where the
text is null or has no letter (numerals such as ½ are none), and for every text where
nothing could be learned, as from an empty or unlabelled table. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import fold_of, hash_share, share_kept, text_udf

PER_LANGUAGE = 600
BUCKETS = 1 << 16  # as many as 16 bits tell
BLOCK = 64
WINDOW = 32
LETTERS = 1 << 20  # letters of words that are worked on together
UNKNOWN = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[str]:
    """The runs of letters, in lower case; numerals that are no digits end a run."""
    found = _WORDS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def feature_parts(words: list[str], lexicon: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, words): the hashed affixes, n-grams and, if frequent, wholes of all words, by kind, as numbers of ``words``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes + 2)
    starts, owner = ends - sizes - 2, np.repeat(np.arange(len(words)), sizes + 2)

    def bucket(kind: int, letters: list[np.ndarray]) -> np.ndarray:
        total = np.array([kind], np.uint64) * _FACTORS[-1:]
        for factor, letter in zip(_FACTORS, letters, strict=False):
            total = total + letter * factor
        return ((total ^ (total >> np.uint64(29))) * _FACTORS[0] >> np.uint64(48)).astype(np.int64)

    for k in (2, 3):
        at = np.flatnonzero(np.arange(len(codes)) <= (ends - k)[owner])
        yield bucket(k, [codes[at + j] for j in range(k)]), owner[at]
    every = np.arange(len(words))
    for kind, first, step in ((10, starts + 1, 1), (20, ends - 2, -1)):
        letters: list[np.ndarray] = []
        for k in range(4):
            letters.append(np.where(k < sizes, codes[np.clip(first + k * step, 0, len(codes) - 1)], np.uint64(0)))
            yield bucket(kind + k, letters), every
    whole = [(k, number) for k, w in enumerate(words) if (number := lexicon.get(w)) is not None]
    if whole:
        at, number = np.array(whole).T
        yield bucket(30, [number.astype(np.uint64)]), at


def word_buckets(words: list[str], lexicon: dict[str, int], together: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words one after another, and how many each has."""
    buckets, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for low in range(0, len(words), together):
        some = words[low : low + together]
        parts = list(feature_parts(some, lexicon))
        owners = np.concatenate([o for _, o in parts])
        buckets.append(np.concatenate([b for b, _ in parts])[np.argsort(owners, kind="stable")].astype(np.uint16))
        sizes.append(np.bincount(owners, minlength=len(some)))
    return np.concatenate(buckets), np.concatenate(sizes)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # buckets by languages
    transitions: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of each word for each language; words are worked on a million letters at a time."""
        out, low = np.zeros((len(words), len(self.languages))), 0
        while low < len(words):
            high, letters = low, 0
            while high < len(words) and (high == low or letters + len(words[high]) <= LETTERS):
                letters += len(words[high])
                high += 1
            counts = np.zeros(high - low)
            for buckets, owners in feature_parts(words[low:high], self.lexicon):
                counts += np.bincount(owners, minlength=high - low)
                for k in range(out.shape[1]):
                    out[low:high, k] += np.bincount(owners, self.weights[buckets, k], high - low)
            out[low:high] /= np.sqrt(counts)[:, None]
            low = high
        return out


class Scorer:
    """Marginals for batches of texts; word scores are kept in a bounded table."""

    def __init__(self, crf: Crf, entries: int = 250_000):
        self.crf, self.limit = crf, entries
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(crf.languages)), np.float32)
        self.step = np.exp(crf.transitions - crf.transitions.max()).astype(np.float32) if crf.languages else None

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' places in the table; each distinct one is looked up once."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), self.index
        new = [w for w in distinct if w not in index]
        if new:
            have = len(index)
            while have + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            e = self.crf.emissions(new)
            self.table[have : have + len(new)] = np.exp(e - e.max(1, keepdims=True))
            index.update(zip(new, range(have, have + len(new)), strict=True))
        return np.array([index[w] for w in distinct], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, its mean marginal, and the mean of each word's largest marginal."""
        if len(self.index) > self.limit:
            self.index.clear()
        found = [words_of(t) if t and self.crf.languages else [] for t in texts]
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        filled = [i for i, r in enumerate(found) if r]
        if not filled:
            return out
        at = self.rows([w for i in filled for w in found[i]])
        means, certain = doc_marginals(self.table, np.split(at, np.cumsum([len(found[i]) for i in filled])[:-1]), self.step)
        best = means.argmax(1)
        for i, k, m, c in zip(filled, best, means, certain, strict=True):
            out[i] = (self.crf.languages[k], float(min(1.0, m[k])), float(min(1.0, c)))
        return out


def doc_marginals(table: np.ndarray, docs: list[np.ndarray], step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean marginals of each document's words, and the mean of each word's largest; all documents together."""
    n_lang = step.shape[0]
    sizes = np.array([len(d) for d in docs])
    blocks = -(-sizes // BLOCK)
    first = np.cumsum([0, *blocks[:-1]])
    total = int(blocks.sum())
    # padding has a neutral emission and an identity step
    emission = np.ones((total, BLOCK, n_lang), np.float32)
    real = np.zeros((total, BLOCK), bool)
    flat, flags = emission.reshape(-1, n_lang), real.reshape(-1)
    for d, at in zip(docs, first, strict=True):
        flat[at * BLOCK : at * BLOCK + len(d)] = table[d]
        flags[at * BLOCK : at * BLOCK + len(d)] = True
    eye = np.eye(n_lang, dtype=np.float32)
    opening = np.zeros(total, bool)
    opening[first] = True

    def stepped(k: int) -> np.ndarray:
        """The step before word k of each block: identity where a document opens or padding stands."""
        plain = real[:, k] & ~opening if k == 0 else real[:, k]
        return np.where(plain[:, None, None], step, eye)

    product = np.broadcast_to(eye, (total, n_lang, n_lang)).copy()
    for k in range(BLOCK):
        product = (product @ stepped(k)) * emission[:, k, None, :]
        product /= product.sum((1, 2), keepdims=True)
    into = np.full((total, n_lang), 1.0 / n_lang, np.float32)
    back = np.full((total, n_lang), 1.0 / n_lang, np.float32)
    for k in range(1, int(blocks.max())):
        at = first[blocks > k] + k
        v = (into[at - 1][:, None, :] @ product[at - 1])[:, 0]
        into[at] = v / v.sum(1, keepdims=True)
        at = (first + blocks - 1)[blocks > k] - k
        v = (product[at + 1] @ back[at + 1][:, :, None])[:, :, 0]
        back[at] = v / v.sum(1, keepdims=True)
    alpha = np.empty_like(emission)
    state = into
    for k in range(BLOCK):
        state = (state[:, None, :] @ stepped(k))[:, 0] * emission[:, k]
        state /= state.sum(1, keepdims=True)
        alpha[:, k] = state
    state = back
    sums, tops = np.zeros((total, n_lang)), np.zeros(total)
    for k in range(BLOCK - 1, -1, -1):
        gamma = alpha[:, k] * state
        gamma /= gamma.sum(1, keepdims=True)
        sums += gamma * real[:, k, None]
        tops += gamma.max(1) * real[:, k]
        state = (stepped(k) @ (emission[:, k] * state)[:, :, None])[:, :, 0]
        state /= state.sum(1, keepdims=True)
    return np.add.reduceat(sums, first, axis=0) / sizes[:, None], np.add.reduceat(tops, first) / sizes


def _windows(docs: list[tuple[np.ndarray, int]], seed: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Windows of words (numbers) with a label for each word; every other pair of windows swaps its ends, so both switch within."""
    pieces = [(words[i : i + WINDOW], y) for words, y in docs for i in range(0, len(words), WINDOW)]
    order = np.random.default_rng(seed).permutation(len(pieces)).tolist()
    windows, labels = [pieces[k][0] for k in order], np.full((len(pieces), WINDOW), -1, np.int16)
    for n, k in enumerate(order):
        labels[n, : len(windows[n])] = pieces[k][1]
    for n in range(0, len(windows) - 1, 4):
        (one, two), (y, z) = windows[n : n + 2], labels[n : n + 2, 0].tolist()
        cut = 1 + (n * 7919) % max(1, min(len(one), len(two)) - 1)
        windows[n : n + 2] = np.concatenate([one[:cut], two[cut:]]), np.concatenate([two[:cut], one[cut:]])
        labels[n : n + 2] = -1
        for row, words, first, rest in zip(labels[n : n + 2], windows[n : n + 2], (y, z), (z, y), strict=True):
            row[: len(words)] = rest
            row[: min(cut, len(words))] = first
    return windows, labels


def fit(rows: list[tuple[str, str]], epochs: int = 3, batch: int = 192, rate: float = 0.3, lexicon_size: int = 2000, seed: int = 7) -> Crf:
    """Maximum likelihood of the labels by Adagrad; gradients are observed minus expected counts."""
    languages = sorted({y for _, y in rows})
    at = {y: k for k, y in enumerate(languages)}
    n_lang = len(languages)
    place: dict[str, int] = {}
    docs = [(np.array([place.setdefault(w, len(place)) for w in words_of(t)], np.int32), at[y]) for t, y in rows]
    counts = np.bincount(np.concatenate([d for d, _ in docs])) if place else np.zeros(0, np.int64)
    names = list(place)
    frequent = np.lexsort((np.arange(len(names)), -counts))[:lexicon_size]
    lexicon = {names[k]: n for n, k in enumerate(frequent.tolist()) if counts[k] >= 5}
    crf = Crf(languages, np.zeros((BUCKETS, n_lang)), np.zeros((n_lang, n_lang)), lexicon)
    windows, labels = _windows(docs, seed)
    buckets, sizes = word_buckets(names, lexicon)
    begins = np.cumsum(sizes) - sizes
    squares, square_t = np.full_like(crf.weights, 1e-3), np.full_like(crf.transitions, 1e-3)
    for _ in range(epochs if n_lang > 1 else 0):
        for low in range(0, len(windows), batch):
            some, y = windows[low : low + batch], labels[low : low + batch]
            mask = y >= 0
            words = np.concatenate(some)
            n_feats = sizes[words]
            starts = np.cumsum(n_feats) - n_feats
            flat = buckets[np.repeat(begins[words] - starts, n_feats) + np.arange(n_feats.sum())]
            scale = 1 / np.sqrt(n_feats)
            scores = np.zeros((*y.shape, n_lang))
            scores[mask] = np.add.reduceat(crf.weights[flat], starts, axis=0) * scale[:, None]
            gamma, expected = _expectations(scores, crf.transitions, mask)
            observed = np.eye(n_lang)[np.maximum(y, 0)]
            gradient = ((observed - gamma) * mask[..., None])[mask] * scale[:, None]
            g = np.zeros_like(crf.weights)
            for k in range(n_lang):
                g[:, k] = np.bincount(flat, np.repeat(gradient[:, k], n_feats), BUCKETS)
            both = mask[:, 1:]
            seen = np.zeros((n_lang, n_lang))
            np.add.at(seen, (np.maximum(y, 0)[:, :-1][both], np.maximum(y, 0)[:, 1:][both]), 1)
            gt = (seen - expected) / len(some)
            g /= len(some)
            touched = np.unique(flat)
            squares[touched] += g[touched] ** 2
            crf.weights[touched] += rate * g[touched] / np.sqrt(squares[touched])
            square_t += gt**2
            crf.transitions += rate * gt / np.sqrt(square_t)
    return crf


def _expectations(scores: np.ndarray, transitions: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words, and expected transition counts, of windows padded at their ends."""
    n, t, n_lang = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha, beta = np.zeros_like(e), np.ones_like(e) / n_lang
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, t):
        v = alpha[:, k - 1] @ step * e[:, k]
        alpha[:, k] = np.where(mask[:, k, None], v / v.sum(1, keepdims=True), alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        v = (e[:, k + 1] * beta[:, k + 1]) @ step.T
        beta[:, k] = np.where(mask[:, k + 1, None], v / v.sum(1, keepdims=True), beta[:, k + 1])
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return gamma, (pair * mask[:, 1:, None, None]).sum((0, 1))


def train(documents: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fit on a bounded sample: ids are chosen from slim rows, then their texts are fetched."""
    rows = documents.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
    slim = rows.select(F.col(id_col).alias("picked_id"), F.col(lang_col).alias("lang"))
    picked = slim.where(hash_share("picked_id", "lang", share_kept(slim, "lang", per_language))).distinct()
    texts = documents.select(F.col(id_col).alias("picked_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "picked_id")
    got = sorted((r["picked_id"], r["lang"], r["text"]) for r in texts.where(F.col("text").isNotNull()).collect())
    return fit([(t, y) for _, y, t in got])


def language_of(text: Column, crf: Crf) -> Column:
    """A struct (lang, score, certainty) of a text column; certainty is the mean of each word's largest marginal."""

    def make():
        scorer = Scorer(crf)

        def each(texts: list) -> list:
            return [{"lang": y, "score": s, "certainty": c} for y, s, c in scorer.judge(texts)]

        return each

    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("certainty", pa.float64())])
    return text_udf(make, "struct<lang:string,score:double,certainty:double>", kind)(text)


def held_out(id_col: str | Column) -> Column:
    return F.coalesce(fold_of(id_col, 5) == 0, F.lit(False))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crf = train(docs, held_out("doc_id"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), language_of(F.col("text"), crf).alias("found"))
    return scored.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))

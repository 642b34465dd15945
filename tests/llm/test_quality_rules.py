"""Quality rules: counts against plain loops, the curve against a search, held-out documents of an invented corpus."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import quality_rules as rules_

BLANKS = " \t\n\x0b\x0c\r"


def plain(text):
    """The five counts, word by word."""
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in BLANKS:
            words += [now] if now else []
            now = ""
        else:
            now += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered)


ODD = [None, "", " \t\n", "x" * 100_000, "a b c " * 20_000, "a b c", "a b c a b c", "a a a", "a a a a", "é ß  x", "l\nl\n l\nl", "# * | <é>\x0bz\x0cy\rw", "日本 語 " * 60]


def test_counts_against_a_loop(spark, monkeypatch):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(["a", "b", "ab", " ", "  ", "\n", "#", "é"], k=rng.randrange(0, 200))) for _ in range(300)]
    rows = [(k, t, "x", 1, True) for k, t in enumerate(texts)] + [(None, "a b", None, None, None), (5, "a b c", "x", 1, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, n_words long, kept boolean").repartition(3)
    got = rules_.quality_rules(df, rules_.Rules(np.zeros(rules_.BUCKETS), 0.0))
    assert got.columns == ["doc_id", "text", "found", *rules_.COUNTS, "base_failed", "kept", "probability"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        counts = plain(r["text"])
        assert tuple(r[c] for c in rules_.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r["kept"] == (not r["base_failed"]) and r["probability"] == 0.5
    assert rules_.quality_rules(df.limit(0), rules_.Rules(np.zeros(rules_.BUCKETS), 0.0)).count() == 0


def test_pieces_do_not_change_features(monkeypatch):
    rng = random.Random(3)
    for text in (*(t or "" for t in ODD[:4]), "".join(rng.choices("abc é\n", k=3000))):
        raw = text.encode()
        whole = rules_.hashed(raw, *rules_.word_numbers(raw))
        with monkeypatch.context() as m:
            m.setattr(rules_, "PIECE", 7 if len(raw) < 5000 else 999)
            assert np.array_equal(rules_.hashed(raw, *rules_.word_numbers(raw)), whole)
        lengths = (whole.reshape(2, -1) ** 2).sum(1)
        assert all(x == 0 or abs(x - 1) < 1e-9 for x in lengths)


def test_the_curve_fits_best():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=400) * 3
    labels = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * margins - 1)))).astype(float)
    weights = rng.random(400) + 0.5
    slope, shift = rules_.calibrated(margins, labels, weights)
    good, bad = labels.sum(), 400 - labels.sum()
    wanted = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    loss = lambda a, b: (weights * (np.logaddexp(0, a * margins + b) - wanted * (a * margins + b))).sum()
    assert all(loss(slope, shift) <= loss(slope + a, shift + b) + 1e-9 for a in (-0.05, 0, 0.05) for b in (-0.05, 0, 0.05)) and 0.3 < slope < 0.8
    apart = rules_.calibrated(np.array([-5.0, -4, 4, 5]), np.array([0.0, 0, 1, 1]), np.ones(4))
    assert np.isfinite(apart).all() and apart[0] > 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Good documents of one vocabulary, bad ones of another; a few share words."""
    rng = random.Random(5)
    good, bad = [f"{a}{b}on" for a in "bcdfgl" for b in "aeiou"], [f"{a}{b}zz%" for a in "bcdfgl" for b in "aeiou"]
    rows = [(k, " ".join(rng.choices(bad if k % 4 == 0 else good, k=70)) + (" shared words" if k % 3 == 0 else ""), "en", "s") for k in range(800)]
    labels = [(k, int(k % 4 != 0)) for k in range(800)] + [(3, None), (None, 1), (1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_judged(spark, labelled):
    docs, labels = labelled
    made = rules_.train(docs, labels, rules_.held_out("doc_id"))
    got = {r["doc_id"]: r for r in rules_.quality_rules(docs, made).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(held) > 150 and all(got[k]["kept"] == (k % 4 != 0) for k in held)
    assert np.mean([(got[k]["probability"] - (k % 4 != 0)) ** 2 for k in held]) < 0.03


def test_rules_of_nothing(spark, labelled):
    docs, labels = labelled
    for d, n, want in ((docs.limit(0), labels, None), (docs, labels.limit(0), 0.5), (docs, labels.where("quality = 1"), 0.99), (docs, labels.withColumn("quality", F.lit(None).cast("int")), 0.5)):
        made = rules_.train(d, n, rules_.held_out("doc_id"))
        found = {round(r["probability"], 6) for r in rules_.quality_rules(docs.limit(5), made).collect()}
        assert len(found) == 1 and (want is None or found == {want})

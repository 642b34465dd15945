"""The filter audit against a loop over all rows and orders, and its defined cases."""

from itertools import permutations

import pytest

from lodestack.llm import filter_audit

PLAIN = " ".join(f"word{k}" for k in range(60))
TEXTS = [
    PLAIN, PLAIN, PLAIN + " #", None, "", " \t\n", "A" * 300, "a b " * 40, "B " * 60 + "%", PLAIN.upper(), PLAIN + " x", PLAIN + "  x", "é" * 99, "word " * 50_000, "|", PLAIN,
]


def fails(text):
    words = text.translate({k: " " for k in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {
        k
        for k, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), any(c in text for c in "#$%&*|")), strict=True)
        if bad
    }


def brute(rows, labels):
    """Every order, row by row; ``rows`` are (id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    told = []
    for i, text, part in rows:
        text = text or ""
        faults = fails(text)
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            faults.add("E")
        told.append((i, part or "", faults))
    out = {}
    for part in {p for _, p, _ in told}:
        own = [(i, f) for i, p, f in told if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                sums[letter] += len(gone)
                failing = sum(letter in f for _, f in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for key in out:
            if key[0] == part and len(out[key]) == 6:
                out[key].append(sums[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "m", 1, True) for r in rows], "doc_id long, text string, source string, mask string, n long, first boolean").repartition(3)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len({r[:3] for r in got})
    return {tuple(r[:3]): tuple(r[3:]) for r in got}


@pytest.mark.parametrize("parts", [("a", "b", None, ""), ("a",)])
def test_audit_against_a_loop(spark, parts):
    rows = [(k, t, parts[k % len(parts)]) for k, t in enumerate(TEXTS)]
    rows += [rows[1], rows[1], (None, PLAIN, "a"), (None, None, None), (2, PLAIN + " #", "other")]
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (2, None, 1), (None, 1, 1), (999, 1, 1), (9, 1, None)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, None, "a")], []) == brute([(1, None, "a")], [])

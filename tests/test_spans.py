"""Spans in long texts: passages around them, and whether they stand there once."""

import random
import time

import pytest

from lodestack.operators import evaluate, evidence


@pytest.mark.parametrize("searched", [0, evidence.SEARCHED])
def test_spans_that_stand_once(monkeypatch, searched):
    monkeypatch.setattr(evidence, "SEARCHED", searched)
    rng = random.Random(7)
    for letters in ("ab", "abc ", "aé日😀 ", "x"):
        for _ in range(150):
            text = "".join(rng.choices(letters, k=rng.randrange(1, 120)))
            spans = []
            for _ in range(rng.randrange(0, 25)):
                a = rng.randrange(len(text))
                spans.append((a, rng.randrange(a + 1, min(len(text), a + 30) + 1)))
            assert evidence.stand_once(text, spans) == [text.count(text[a:b]) == 1 for a, b in spans]
    assert evidence.stand_once("", []) == []


def test_many_spans_take_time_in_proportion():
    rng = random.Random(2)
    times = []
    for n in (4000, 16_000):
        lines = [" ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=14)) for _ in range(n)]
        text = "\n".join(lines)
        began = time.process_time()
        got = list(evidence.local_gates(text, None, evidence.Limits()))
        times.append(time.process_time() - began)
        assert len(got) == n and sum(r[-1] is None for r in got) > 0.9 * n
    assert times[1] < 9 * times[0]


def plain(spans, nodes):
    return {s: sorted({n for j, n, a, b in nodes if j == s[0] and None not in (j, a, b, s[1], s[2]) and s[1] <= s[2] and a <= b and a <= s[1] and b >= s[2]}) for s in spans}


def test_passages_around_spans(spark):
    rng = random.Random(4)
    nodes, spans = [], []
    for k in range(400):
        a = rng.randrange(0, 5000)
        nodes.append((f"j{k % 3}", f"n{k}", a, a + rng.choice([0, 1, 2, 63, 64, 65, 1000, 4999])))
        b = rng.randrange(0, 5000)
        spans.append((f"j{k % 4}", b, b + rng.choice([0, 0, 1, 40, 64, 900])))
    nodes += [("j0", "back", 9, 3), ("j0", None, 0, 10), (None, "no job", 0, 9999), ("j1", "open", 5, None), nodes[0]]
    spans += [("j0", 5, 4), (None, 1, 2), ("j1", None, 3), spans[0]]
    n = spark.createDataFrame(nodes, "job string, node_id string, start_offset long, end_offset long")
    s = spark.createDataFrame(spans, "job string, start long, end long")
    got = evaluate.enclosing(s, n.where("node_id IS NOT NULL")).collect()
    want = plain(set(spans), [x for x in nodes if x[1] is not None])
    wrong = [(r, want[r["job"], r["start"], r["end"]]) for r in got if r["node_ids"] != want[r["job"], r["start"], r["end"]]]
    assert len(got) == len(spans) and not wrong
    assert [r["node_ids"] for r in evaluate.enclosing(s, n.limit(0)).collect()] == [[]] * len(spans)


def test_passages_of_a_long_text_meet_few_spans(spark):
    """10 MB in passages of a thousand characters, and as many spans: what is compared is linear."""
    n = 11_000
    nodes = spark.range(n).selectExpr("'j' AS job", "CAST(id AS STRING) AS node_id", "id * 900 AS start_offset", "id * 900 + 1000 AS end_offset")
    spans = spark.range(n).selectExpr("'j' AS job", "id * 900 + 20 AS start", "id * 900 + 90 AS end")
    found = evaluate.enclosing_pairs(spans, nodes)
    assert found.count() == 2 * n - 1
    joined = found._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in joined and "NestedLoop" not in joined and "Cartesian" not in joined

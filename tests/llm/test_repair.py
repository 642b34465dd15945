"""Repairs of conversations against a search over all edits, and their defined cases."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from lodestack.llm import repair

BLANKS = " \t\n\x0b\x0c\r"


def faults(rows):
    """The first fault of each (turn, role, text) in order."""
    out = []
    for k, (_, role, text) in enumerate(rows):
        if not text.strip(BLANKS):
            out.append("blank")
        elif any((role, text) == r[1:] for r in rows[:k]):
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(BLANKS)[-1] in ".!?" else "truncated")
    return out


def cheapest(rows, told):
    """Uniform-cost search over the role initials written so far, as seen by the grammar: least cost, then least audit."""
    grammar = re.compile(r"(s?(ua)+)?\Z")
    prefixes = {"": "", "s": "s", "u": "u", "ua": "ua", "su": "u", "sua": "ua", "uau": "u", "uaua": "ua"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, said, out = heapq.heappop(heap)
        if at == len(rows) and grammar.match(said):
            return cost, audit, out
        if (at, said) in seen:
            continue
        seen.add((at, said))

        def go(price, letter, to, more, cost=cost, audit=audit, said=said, out=out):
            new = prefixes.get(said + more[0][:1]) if more else said
            if new is not None:
                heapq.heappush(heap, (cost + price, audit + letter, to, new, out + ((more,) if more else ())))

        for role in ("user", "assistant"):
            go(3, "I", at, (role, ""))
        if at < len(rows):
            _, role, text = rows[at]
            go(4, "D", at + 1, None)
            if told[at] in ("", "truncated"):
                more = 3 if told[at] else 0
                if role[:1] in ("s", "u", "a"):
                    go(more, "K", at + 1, (role, text))
                for other in ("user", "assistant"):
                    go(3 + more, "R", at + 1, (other, text))


def wanted(rows):
    """``rows`` of one conversation, in order."""
    told = faults(rows)
    cost, audit, out = cheapest(rows, told)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [told.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def in_order(rows):
    shown = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(shown, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def hurt(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate:
            out += [(turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)] * (2 if fate == 3 else 1)
    return out


def some(rng, n):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "sys", "Ä"], ["Yes.", "No", " \t", "", None, "a b?", "a\n.\n ", "é!", "go on", ". x", " "]
    return [(rng.choice([None, k, k, k, k + 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}{rng.choice('. !?')}") for k in range(n)]


@pytest.mark.parametrize("block, damage", [(3, False), (4096, True)])
def test_repairs_against_a_search(spark, block, damage):
    rng = random.Random(block)
    convs = {k: some(rng, rng.choice([1, 2, 3, 5, 8, 13])) for k in range(60)} | {None: some(rng, 9), 99: [(1, "user", "Hi.")] * 7, 98: [(None, None, None)], 97: some(rng, 60)}
    rows = [(c, *r, "x", 1) for c, turns in convs.items() for r in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, block long").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_conversations(df, damage=damage, block=block).collect()}
    want = {c: wanted(in_order(hurt(c, turns) if damage else turns)) for c, turns in convs.items()}
    assert got == want


def test_distances_go_through_blocks():
    """Chained matrices give the distances of the whole."""
    rng = random.Random(4)
    for _ in range(200):
        codes = [rng.randrange(16) for _ in range(rng.randrange(1, 20))]
        cut = rng.randrange(len(codes) + 1)
        exits = repair._exits([repair.through(codes[cut:])])[0]
        whole = repair.distances(codes, repair._END)
        assert repair.distances(codes[:cut], exits) == whole[: (cut + 1) * repair.STATES]
        edits, end = repair.walk(codes[:cut], whole[: (cut + 1) * 4], 0, False)
        more, last = repair.walk(codes[cut:], whole[cut * 4 :], end, True)
        assert (edits + more, last) == repair.walk(codes, whole, 0, True) and last in repair.ENDS


def test_nothing_to_repair(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_conversations(df).collect() == []
    lost = next(k for k in range(999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], df.schema)
    assert [tuple(r) for r in repair.repair_conversations(df, damage=True).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]

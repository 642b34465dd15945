"""Repair of conversation structure by shortest paths, with an audit of the edits.

Turns are numbered in the order of their conversation and coded to a letter each: the
initial of the role and the first fault. A conversation is cut into blocks of
``BLOCK`` turns. The graph of a block has four states between turns (nothing yet, after a
system, a user, an assistant turn) and arcs for the edits, with costs up to six, so Dial's
ring of buckets finds all distances to the end. A block that others follow gets these from
them: the costs of its states through each later block are a matrix of four by four, and
matrices are small enough to be chained by conversation. Then each block walks the arcs
that its distances are tight on, the ASCII-least first, from each state it may be entered
in, and the entries are chained likewise. At last the turns of a conversation pass one
task in order, which holds no more than a batch of them and the audit, since its digest
is sequential; costly work is done by block before.

Turns are taken by turn number (nulls first), ties by role, then by the text's SHA-256.
Faults, the first one counts: ``blank`` (nothing but ``[\\x20\\x09-\\x0D]``), ``duplicate``
(role and text seen earlier), ``truncated`` (last other character not one of ``.!?``).
Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate
turns), Insert an empty user or assistant turn 3; truncated turns that stay cost 3 more.
The role initials that result are ``(s?(ua)+)?``.

Defined results: null roles and texts are one space, a null conversation id is a
conversation of its own, rows repeated are duplicates. Conversations of ``known`` without
turns have zero counts, an empty audit and the digest of nothing. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from lodestack.llm.common import discard, map_arrow, mapped, written
from lodestack.operators.numbering import numbered

BLOCK = 4096
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_DEAREST = REROLE + TRUNCATED
#: States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
STATES, ENDS = 4, (0, 3)
FAR = 1 << 40
_ROLES = {2: "user", 3: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_CODES = "ABCDEFGHIJKLMNOP"


def wanted(state: int) -> int:
    """The state behind the one turn that may be inserted or reroled to."""
    return 3 if state == 2 else 2


def kept_to(state: int, initial: int) -> int | None:
    """The state behind a turn that keeps its role, None where that is illegal."""
    if initial == 0:
        return 1 if state == 0 else None
    return wanted(state) if initial == wanted(state) - 1 else None


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """Of each state, the edits of a turn: letter, state behind, cost; in the order of their letters."""
    initial, fault = divmod(code, len(FAULTS))
    out = []
    for state in range(STATES):
        edits = [("D", state, DELETE)]
        if fault in (0, 3):
            more = TRUNCATED if fault == 3 else 0
            if (behind := kept_to(state, initial)) is not None:
                edits.append(("K", behind, KEEP + more))
            edits.append(("R", wanted(state), REROLE + more))
        out.append(edits)
    return out


ARCS = [_arcs(code) for code in range(len(_CODES))]
#: The same backwards: of each code and state, the states before and their least costs.
BACK = [[[(s, min(c for _, t, c in arcs[s] if t == state)) for s in range(STATES) if any(t == state for _, t, _ in arcs[s])] for state in range(STATES)] for arcs in ARCS]
BACK_INSERT = [[s for s in range(STATES) if wanted(s) == state] for state in range(STATES)]


def distances(codes: list[int], exits: list[int]) -> list[int]:
    """Costs from every node (turns passed x ``STATES`` + state) to the end, given those of the last nodes: Dial's buckets."""
    n, least = len(codes), min(exits)
    ring = max(_DEAREST, max((e - least for e in exits if e < FAR), default=0)) + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    cost = [FAR] * ((n + 1) * STATES)
    waiting = 0
    for state, e in enumerate(exits):
        if e < FAR:
            cost[n * STATES + state] = e - least
            buckets[e - least].append(n * STATES + state)
            waiting += 1
    at = 0
    while waiting:
        bucket = buckets[at % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if cost[node] != at:
                continue
            turn, state = divmod(node, STATES)
            first = node - state
            for before in BACK_INSERT[state]:
                if at + INSERT < cost[first + before]:
                    cost[first + before] = at + INSERT
                    buckets[(at + INSERT) % ring].append(first + before)
                    waiting += 1
            if turn:
                first -= STATES
                for before, more in BACK[codes[turn - 1]][state]:
                    if at + more < cost[first + before]:
                        cost[first + before] = at + more
                        buckets[(at + more) % ring].append(first + before)
                        waiting += 1
        at += 1
    return [c + least if c < FAR else FAR for c in cost]


def walk(codes: list[int], cost: list[int], state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least edits along tight arcs from ``state``, and the state they end in; the last block goes on to the end."""
    edits, turn, n = [], 0, len(codes)
    while turn < n or (last and cost[turn * STATES + state]):
        here = cost[turn * STATES + state]
        choices = [("I", wanted(state), INSERT, 0)]
        if turn < n:
            choices += [(*arc, 1) for arc in ARCS[codes[turn]][state]]
        edit, state, _, passed = min(c for c in choices if cost[(turn + c[3]) * STATES + c[1]] + c[2] == here)
        edits.append(edit)
        turn += passed
    return "".join(edits), state


_END = [0 if s in ENDS else FAR for s in range(STATES)]


def through(codes: list[int]) -> list[int]:
    """Costs from each state before a block to each state behind it, row by row."""
    columns = [distances(codes, [0 if s == t else FAR for s in range(STATES)])[:STATES] for t in range(STATES)]
    return [columns[t][s] for s in range(STATES) for t in range(STATES)]


def _exits(matrices: list[list[int]]) -> list[list[int]]:
    """Costs behind each of the blocks but the last, given the matrices of all but the first."""
    found = [distances([], _END)]
    for m in reversed(matrices):
        found.append([min(m[s * STATES + t] + found[-1][t] for t in range(STATES)) for s in range(STATES)])
    return found[:0:-1]


def _entries(ends: list[list[int]]) -> list[int]:
    """The states that blocks are entered in, given the states that each leads to from every entry (the first from nothing only)."""
    found = [0]
    for e in ends[:-1]:
        found.append(e[found[-1]])
    return found


_exits_of = F.udf(lambda chain: _exits(chain), ArrayType(ArrayType(LongType())))
_entries_of = F.udf(lambda chain: _entries(chain), ArrayType(LongType()))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Planted faults by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fate = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    rows = rows.withColumn("text", F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))).drop("col")


def _coded(turns: DataFrame, block: int) -> DataFrame:
    """``turns`` numbered, with their block and the letter of their initial and first fault."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = turns.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), blank.alias("blank"), cut.alias("cut"), F.monotonically_increasing_id().alias("row"))
    rows = numbered(rows, "conv", ["turn", "role", "digest", "row"], "n").drop("row")
    firsts = rows.where("not blank").groupBy("conv", "role", "digest").agg(F.min("n").alias("first")).select(F.col("conv").alias("own"), "first")
    told = rows.join(firsts, F.col("conv").eqNullSafe(F.col("own")) & (F.col("n") == F.col("first")), "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), len(INITIALS)).otherwise(initial)
    code = F.substring(F.lit(_CODES), initial * len(FAULTS) + fault + 1, F.lit(1))
    return told.select("conv", "turn", "role", "text", "n", F.floor((F.col("n") - 1) / block).alias("block"), code.alias("code"))


def _by_block(df: DataFrame, each, schema: str) -> DataFrame:
    """``df`` (its strings ``codes`` read as numbers) through ``each``, which maps a dictionary to a tuple or to none."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [each(r | {"codes": [ord(c) - ord(_CODES[0]) for c in r["codes"]]}) for r in batch.to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.field(k).type) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], f.type) for f in kinds], schema=kinds)

        return run

    return map_arrow(df, make, schema, by="codes")


def walked(coded: DataFrame, bag: list[str]) -> DataFrame:
    """(conv, block, cost, audit): the edits of each block; ``cost`` is that of the conversation, in its first block."""
    kind = dict(coded.dtypes)["conv"]
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]), "")
    blocks = written(coded.groupBy("conv", "block").agg(codes.alias("codes")), "repair-blocks", bag=bag)
    matrices = _by_block(blocks.where("block > 0"), lambda r: (r["conv"], r["block"], through(r["codes"])), f"conv {kind}, block long, matrix array<long>")
    chains = matrices.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "matrix"))), lambda x: x["matrix"]).alias("chain"))
    later = written(chains.select(F.col("conv").alias("own"), F.posexplode(_exits_of("chain")).alias("place", "exits")), "repair-exits", bag=bag)
    same = F.col("conv").eqNullSafe(F.col("own")) & (F.col("block") == F.col("place"))
    known = blocks.join(later, same, "left").select("conv", "block", "codes", "exits")

    def each(r: dict) -> tuple:
        cost = distances(r["codes"], r["exits"] or _END)
        found = [walk(r["codes"], cost, s, r["exits"] is None) for s in range(STATES if r["block"] else 1)]
        return r["conv"], r["block"], cost[0], [a for a, _ in found], [s for _, s in found]

    found = written(_by_block(known, each, f"conv {kind}, block long, cost long, audits array<string>, ends array<long>"), "repair-walks", bag=bag)
    many = blocks.groupBy("conv").agg(F.max("block").alias("last")).where("last > 0").select(F.col("conv").alias("own"))
    chained = found.join(many, F.col("conv").eqNullSafe(F.col("own"))).groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "ends"))), lambda x: x["ends"]).alias("chain"))
    entries = chained.select("own", F.posexplode(_entries_of("chain")).alias("place", "entry"))
    return found.join(entries, same, "left").select("conv", "block", "cost", F.element_at("audits", (F.coalesce("entry", F.lit(0)) + 1).cast("int")).alias("audit"))


class _Conversation:
    """Counts, audit and digest of a conversation whose turns come in order."""

    def __init__(self, conv):
        self.conv, self.cost, self.faults, self.illegal = conv, 0, [0] * len(FAULTS), 0
        self.least = self.most = self.initial = None
        self.turns = self.at = self.state = 0
        self.audit, self.edits, self.digest, self.empty = [], "", hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state, self.at = wanted(self.state), self.at + 1
            self.say(_ROLES[self.state], "")

    def block(self, cost: int, number: int, audit: str) -> None:
        self.inserted()
        self.cost = self.cost if number else cost
        self.audit.append(audit)
        self.edits, self.at = audit, 0

    def turn(self, number: int | None, role: str, text: str, code: str) -> None:
        self.inserted()
        initial, fault = divmod(_CODES.index(code), len(FAULTS))
        self.faults[fault] += 1
        self.illegal += self.initial is not None and (self.initial, initial) not in _LEGAL
        self.initial = initial
        if number is not None and number != self.most:
            self.least, self.most, self.turns = number if self.least is None else self.least, number, self.turns + 1
        edit, self.at = self.edits[self.at], self.at + 1
        if edit != "D":
            self.state = kept_to(self.state, initial) if edit == "K" else wanted(self.state)
            self.say(role if edit == "K" else _ROLES[self.state], text)

    def row(self) -> tuple:
        self.inserted()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(turns: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of ``turns`` (conv, turn, role, text) or ``known`` (conv): faults, cost, audit and digest of the repaired turns."""
    kind, bag = dict(turns.dtypes)["conv"], []
    coded = written(_coded(turns, block), "repair-turns")
    edits = written(walked(coded, bag), "repair-edits")
    discard(turns.sparkSession, bag)
    empty = {"block": F.lit(-1).cast("long"), "n": F.lit(0).cast("long"), "turn": F.lit(None).cast(dict(turns.dtypes)["turn"]), "role": F.lit(None).cast("string"), "text": F.lit(""), "code": F.lit(None).cast("string"), "cost": F.lit(0).cast("long"), "audit": F.lit(None).cast("string")}
    full = lambda df: df.select("conv", *(F.col(c) if c in df.columns else v.alias(c) for c, v in empty.items()))  # noqa: E731
    rows = full(known.select("conv").distinct()).unionByName(full(edits)).unionByName(full(coded))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "block", "n")
    schema = f"conv {kind}, " + ", ".join(f"{c} long" for c in _FOUND) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def done() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)]
            made = pa.RecordBatch.from_arrays([pa.array(c, first if not k else pa.string() if k > len(_FOUND) else pa.int64()) for k, c in enumerate(columns)], names=["conv", *_FOUND, "audit", "repaired_sha256"])
            out.clear()
            return made

        for batch in batches:
            first = batch.schema.field(0).type
            for conv, number, n, turn, role, text, code, cost, audit in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                        size += len(out[-1][-2])
                        if len(out) >= 10_000 or size > 1 << 20:
                            yield done()
                            size = 0
                    now = _Conversation(conv)
                if number >= 0 and n:
                    now.turn(turn, role, text, code)
                elif number >= 0:
                    now.block(cost, number, audit)
        if now is not None:
            out.append(now.row())
            yield done()

    return mapped(rows, run, schema)


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False, block: int = BLOCK) -> DataFrame:
    """Faults and repairs of every conversation of ``df``; ``damage`` plants faults first."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    turns = damaged(df, conv, turn, role, text) if damage else df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"))
    return repaired(turns, df.select(F.col(conv).alias("conv")), block).withColumnRenamed("conv", conv)


_CRC = "xor(list_reduce(flatten(list_transform(string_split({key}, ''), lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"
_NEXT, _SAYS = "CASE WHEN {st} = 2 THEN 3 ELSE 2 END", "CASE WHEN {st} = 2 THEN 'assistant:' ELSE 'user:' END"
#: Row by row, the cheapest and ASCII-least edits to each state; two insertions in a row lead anywhere.
SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS g,
         {_CRC.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations
), hurt AS (
  SELECT g, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM src WHERE fate <> 0
), placed AS (SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM hurt
), told AS (
  SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial,
         CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), best AS (
  SELECT g, 0::BIGINT AS n, st, cost::BIGINT AS cost, audit, rep
  FROM (SELECT DISTINCT g FROM told), (VALUES (0, 0, '', []::VARCHAR[]), (2, 3, 'I', ['user:']), (3, 6, 'II', ['user:', 'assistant:'])) v(st, cost, audit, rep)
  UNION ALL
  SELECT g, n, st, cost, audit, rep FROM (
    SELECT *, row_number() OVER (PARTITION BY g, st ORDER BY cost, audit) AS place FROM (
      SELECT g, n, CASE more WHEN 0 THEN st1 WHEN 1 THEN {_NEXT.format(st="st1")} ELSE 3 END AS st, cost1 + 3 * more AS cost, audit1 || repeat('I', more) AS audit,
             CASE more WHEN 0 THEN rep1 WHEN 1 THEN list_append(rep1, {_SAYS.format(st="st1")}) ELSE list_concat(rep1, ['user:', 'assistant:']) END AS rep
      FROM (
        SELECT b.g, t.n, more,
               CASE edit WHEN 'D' THEN b.st WHEN 'R' THEN {_NEXT.format(st="b.st")} ELSE CASE WHEN initial = 's' AND b.st = 0 THEN 1 WHEN initial = 'u' AND b.st <> 2 THEN 2 WHEN initial = 'a' AND b.st = 2 THEN 3 END END AS st1,
               b.cost + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost1, b.audit || edit AS audit1,
               CASE edit WHEN 'D' THEN b.rep WHEN 'R' THEN list_append(b.rep, {_SAYS.format(st="b.st")} || text) ELSE list_append(b.rep, role || ':' || text) END AS rep1
        FROM best b JOIN told t ON t.g = b.g AND t.n = b.n + 1 CROSS JOIN (VALUES ('D'), ('K'), ('R')) e(edit) CROSS JOIN (VALUES (0), (1), (2)) c(more)
        WHERE edit = 'D' OR fault IN ('', 'truncated'))
      WHERE st1 IS NOT NULL AND NOT (more = 2 AND st1 = 2)))
  WHERE place = 1
), ended AS (
  SELECT b.g, cost, audit, rep FROM best b JOIN (SELECT g, max(n) AS last FROM told GROUP BY g) l ON b.g = l.g AND b.n = l.last
  WHERE st IN (0, 3) QUALIFY row_number() OVER (PARTITION BY b.g ORDER BY cost, audit) = 1
), pairs AS (SELECT g, lag(initial) OVER (PARTITION BY g ORDER BY n) || initial AS pair FROM told
), wrong AS (SELECT g, count(*) AS illegal FROM pairs WHERE pair NOT IN ('su', 'ua', 'au') GROUP BY g
), counted AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
  FROM told GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(rep, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM src) s LEFT JOIN counted c ON s.g = c.g LEFT JOIN ended e ON s.g = e.g LEFT JOIN wrong w ON s.g = w.g
"""


def op11_repair(spark, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), damage=True)

"""N-gram Jaccard join by a token-group matrix; exact.

A text is the set of its word shingles. Equal sets are one *class*, told by 128 bits. Two
classes link when their Jaccard similarity reaches the threshold t; then each shares at
least ceil(t * n) of its n shingles, so any n - ceil(t * n) + 1 of them hold a shared one.

1. Every class emits the shingles whose hash lies under a bound that depends on its size
   only and falls with it: enough for the count above, with slack, and nested, so a
   smaller set emits whatever part of it a larger one could ask for. Tasks deal packed
   arrays out by hash range; each range finds the shingles that several classes hold.
   A shingle that is frequent within a task's rows is known to be shared there and stays
   there, so no task gathers a frequent shingle.
2. The largest set that a class can link with emits the least; below that bound every
   common shingle is emitted by both. A class with enough shingles of its own there can
   link with none. The others are candidates; only their sets are fetched.
3. Candidates are partitioned into groups of similar documents: sorted by a few of their
   shared tokens, chosen by hash with frequent tokens preferred, and cut where the first
   one changes or a group is full. The sort goes on to the class, so a key that a third
   of all candidates have is many full groups in many tasks.
4. The token-group matrix holds which group holds which token, with the sizes of the sets
   that do. A group asks, for all of its sets at once, for their rarest tokens that other
   groups hold. As many of the asked tokens as the sets' sizes demand must be found in a
   group before the two groups meet at all.
5. Groups that meet are bounded by the stored token union: a set of one group needs
   ceil(t * n) tokens in the union of the other. Only where some do, the other group's
   members are opened and compared, all with all in one matrix product; a spanning forest
   of the links goes on, never all pairs.
6. Components of the links give every document the smallest id reachable.

A cluster of K similar documents is K / 512 groups (or as many as its tokens fill), which
meet pairwise; that is the part that is not linear in the cluster.

A class that emits too few shingles to ask for its partners (about one in a billion) lets
its group meet every group that holds smaller sets.

Defined results: null and empty texts have no shingles and are their own component; a
null id never is a component's id while another is there; rows that repeat an id are
told apart by their text. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import discard, free_name, give_back, mapped, slices, written
from lodestack.llm.components import connected, leads
from lodestack.llm.shingles import class_keys, shingle_sets

_FLUSH = 1_000_000  # emitted tokens of a task's rows that are dealt out together
_FREQUENT = 64  # classes of those rows that make a token frequent there
_RANGE_TOKENS = 400_000
_BROADCAST_ROWS = 200_000
_COMMON_ROWS, _COMMON_CLASSES = 1000, 20_000  # classes of more rows than either allows are broadcast, their rows not shuffled
_LEAST = -(1 << 63)  # the sign bit: with it flipped, unsigned hashes order as signed ones
_GROUP_ROWS, _GROUP_TOKENS = 512, 1 << 16
_MORE_ASKED = 3  # tokens asked for beyond the fewest, so that one chance token opens nothing
_COLUMNS = 4096  # tokens of a matrix product


@dataclass(frozen=True)
class Rule:
    """Shingles of ``n`` words; a link where den * common >= num * union. ``slack`` widens what is emitted."""

    n: int = 5
    num: int = 80
    den: int = 100
    slack: float = 7.0

    def least(self, size):
        """The fewest common shingles of a set of that size with any set linked to it."""
        return (self.num * size + self.den - 1) // self.den

    def linked(self, common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of sizes ``a`` link with which columns of sizes ``b``."""
        return (common > 0) & (self.den * common >= self.num * (a[:, None] + b[None, :] - common))

    def bound(self, size: int) -> int:
        """Hashes up to this are emitted; falls as sizes grow."""
        asked = (1 - self.num / self.den) * size + 1
        wanted = asked + self.slack * math.sqrt(asked) + 1.7 * self.slack
        return min(2**64 - 1, int(wanted / size * 2**64)) if size else 0

    def reach(self, size: int) -> int:
        """The bound of the largest set that links with one of that size: any such set emits what lies under it."""
        return self.bound(self.den * size // self.num)

    def emitted(self, found: np.ndarray) -> np.ndarray:
        return found[: np.searchsorted(found, np.uint64(self.bound(len(found))), "right")]

    def asked(self, size: Column) -> Column:
        return size - F.floor((size * self.num + self.den - 1) / self.den).cast("long") + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _row_key(key: Column, text: Column) -> Column:
    return F.xxhash64(key, text.cast("string"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("row_key", _row_key(F.col("id"), F.col("text")))


def document_sets(keyed: DataFrame, rule: Rule) -> DataFrame:
    """(id, row_key, n, cls, check, m, top, below): the set's size, its class (two keys, null where empty), how many tokens
    it emits, the bound of its largest partner (ordered as signed) and how many tokens lie under that."""
    kind = keyed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                sets = shingle_sets(piece.column("text"), rule.n)
                keys = [class_keys(s) if len(s) else (None, None) for s in sets]
                tops = [rule.reach(len(s)) for s in sets]
                below = [int(np.searchsorted(s, np.uint64(t), "right")) for s, t in zip(sets, tops, strict=True)]
                numbers = [[len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], [len(rule.emitted(s)) for s in sets], [t + _LEAST for t in tops], below]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("row_key"), *(pa.array(x, pa.int64()) for x in numbers)], names=["id", "row_key", "n", "cls", "check", "m", "top", "below"])

    return mapped(keyed, run, f"id {kind}, row_key long, n long, cls long, check long, m long, top long, below long")


def _dealt(tokens: np.ndarray, classes: np.ndarray, shift: int) -> Iterator[tuple]:
    """(range, tokens, classes, counts or None) of one flush; frequent tokens go out as shared already."""
    order = np.argsort(tokens, kind="stable")
    tokens, classes = tokens[order], classes[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(first, len(tokens)))
    each = np.repeat(counts, counts)
    frequent = each > _FREQUENT
    if frequent.any():
        t, c, n = tokens[frequent], classes[frequent], each[frequent]
        for low in range(0, len(t), 50_000):
            part = slice(low, low + 50_000)
            yield int(t[low] >> np.uint64(shift)) if shift < 64 else 0, t[part], c[part], n[part]
        place = np.arange(len(tokens)) - np.repeat(first, counts)
        keep = ~frequent | (place < 2)  # two of them still tell the others that the token is shared
        tokens, classes = tokens[keep], classes[keep]
    ranges = tokens >> np.uint64(shift) if shift < 64 else np.zeros(len(tokens), np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]]))
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(ranges[a]), tokens[a:b], classes[a:b], None


_BLOB = pa.schema([("range", pa.int64()), ("tokens", pa.binary()), ("classes", pa.binary()), ("counts", pa.binary())])


def shared_tokens(keyed: DataFrame, rule: Rule, n_ranges: int) -> DataFrame:
    """(cls, token, df) for every emitted token that several classes hold; rows may repeat."""
    shift = 64 - int(math.log2(n_ranges))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(_dealt(np.concatenate(held), np.concatenate(keys), shift)) if size else []
            cols = [[r[0] for r in rows], [r[1].tobytes() for r in rows], [r[2].tobytes() for r in rows], [None if r[3] is None else r[3].astype(np.int64).tobytes() for r in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BLOB, strict=True)], schema=_BLOB)

        for batch in batches:
            for piece in slices(batch, "text"):
                for found in shingle_sets(piece.column("text"), rule.n):
                    if not len(found) or (key := class_keys(found)[0]) in seen:
                        continue
                    seen.add(key)
                    some = rule.emitted(found)
                    held.append(some)
                    keys.append(np.full(len(some), key, np.int64))
                    size += len(some)
                if size >= _FLUSH:
                    yield flush()
                    held, keys, size = [], [], 0
                    seen.clear()
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        known = [c is not None for c in table.column("counts").to_pylist()]
        tokens = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
        classes = [np.frombuffer(b, np.int64) for b in table.column("classes").to_pylist()]
        counts = [np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist() if b is not None]
        open_t = [t for t, k in zip(tokens, known, strict=True) if not k]
        t = np.concatenate(open_t) if open_t else np.zeros(0, np.uint64)
        c = np.concatenate([x for x, k in zip(classes, known, strict=True) if not k]) if open_t else np.zeros(0, np.int64)
        order = np.lexsort((c, t))
        t, c = t[order], c[order]
        if len(t):
            fresh = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
            t, c = t[fresh], c[fresh]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            n = np.repeat(np.diff(np.append(first, len(t))), np.diff(np.append(first, len(t))))
            t, c, n = t[n > 1], c[n > 1], n[n > 1]
        else:
            n = np.zeros(0, np.int64)
        t = np.concatenate([t, *(x for x, k in zip(tokens, known, strict=True) if k)])
        c = np.concatenate([c, *(x for x, k in zip(classes, known, strict=True) if k)])
        return pa.table({"cls": _signed(c), "token": _signed(t), "df": pa.array(np.concatenate([n, *counts]).astype(np.int64))})

    def met(table: pa.Table) -> pa.Table:
        try:
            return meet(table)
        finally:
            give_back()

    blobs = mapped(keyed.select("text"), deal, "range long, tokens binary, classes binary, counts binary")
    return blobs.groupBy("range").applyInArrow(met, "cls long, token long, df long")


def candidate_classes(classes: DataFrame, shared: DataFrame, rule: Rule) -> DataFrame:
    """The classes that may link: all columns of ``classes``, cid, their shared tokens with document counts up to a bound, and keys to sort by."""
    held = shared.groupBy("cls").agg(F.collect_set(F.struct("token", F.least("df", F.lit(_FREQUENT + 1)).alias("df"))).alias("shared"))
    tokens = F.array_distinct(F.transform("shared", lambda t: t["token"]))
    under = F.size(F.filter("tokens", lambda t: t.bitwiseXOR(F.lit(_LEAST)) <= F.col("top")))
    found = classes.join(held, "cls").withColumn("tokens", tokens).where(F.col("below") - under < rule.asked(F.col("n")))
    chance = lambda t: (F.xxhash64(F.lit(29), t["token"]).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    ranked = F.array_sort(F.transform("shared", lambda t: F.struct((-F.ln(chance(t)) / t["df"]).alias("w"), t["token"].alias("token"))))
    found = found.withColumn("ranked", ranked).withColumns({f"k{i + 1}": F.get("ranked", F.lit(i))["token"] for i in range(3)})
    return found.drop("shared", "ranked").withColumn("cid", F.monotonically_increasing_id())


def _lists(rows: list[list[np.ndarray]]) -> list[pa.Array]:
    """Columns of lists of longs, from rows of arrays."""
    out = []
    for column in zip(*rows, strict=True):
        edges = np.concatenate([[0], np.cumsum([len(x) for x in column])])
        out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), _signed(np.concatenate(column).astype(np.int64))))
    return out


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    values, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[i:j] for i, j in zip(edges, edges[1:], strict=False))


_GROUP = ("cids", "ns", "ms", "row_keys", "classes", "checks", "counts", "tokens", "token", "low", "high")


def similar_groups(candidates: DataFrame) -> DataFrame:
    """One row per group: gid (its first member), the members, and the tokens that it holds with the sizes of their sets."""
    keys = ["k1", "k2", "k3", "cid"]
    ordered = candidates.select(*keys, "n", "m", "row_key", "cls", "check", "tokens").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def group(rows: list) -> list[np.ndarray]:
        numbers = np.array([r[:6] for r in rows], np.int64)
        counts = np.array([len(r[6]) for r in rows])
        tokens = np.concatenate([r[6] for r in rows])
        sizes = np.repeat(numbers[:, 1], counts)
        order = np.lexsort((sizes, tokens))
        at, sized = tokens[order], sizes[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        return [*numbers.T, counts, tokens, at[first], sized[first], sized[last]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now, size = None, 0

        def batch_of(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(r[0][0]) for r in rows], pa.int64()), *_lists(rows)], names=["gid", *_GROUP])

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("cid", "n", "m", "row_key", "cls", "check")]
            for key, row, tokens in zip(batch.column("k1").to_pylist(), zip(*columns, strict=True), _arrays(batch.column("tokens")), strict=True):
                if held and (key != now or len(held) >= _GROUP_ROWS or size + row[1] > _GROUP_TOKENS):
                    done.append(group(held))
                    held, size = [], 0
                now = key
                held.append((*row, tokens))
                size += row[1]
            if done:
                yield batch_of(done)
        if held:
            yield batch_of([group(held)])

    return mapped(ordered, run, "gid long, " + ", ".join(f"{c} array<long>" for c in _GROUP))


def _asking(groups: DataFrame, several: DataFrame, rule: Rule) -> DataFrame:
    """(token, gq, ql, qh, req): what a group asks for, the sizes of its sets that do, and how many finds make a partner (under 1: any group may be one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            columns = [_arrays(batch.column(c)) for c in ("ns", "ms", "counts", "tokens", "others", "spread")]
            for gid, ns, ms, counts, tokens, others, spread in zip(batch.column("gid").to_pylist(), *columns, strict=True):
                order = np.argsort(others)
                others, spread = others[order], spread[order]
                edges = np.concatenate([[0], np.cumsum(counts)])
                asked = []
                for k, (n, m) in enumerate(zip(ns.tolist(), ms.tolist(), strict=True)):
                    own = tokens[edges[k] : edges[k + 1]]
                    at = np.minimum(np.searchsorted(others, own), len(others) - 1)
                    at = at[others[at] == own]
                    need = n - rule.least(n) + 1 - (m - len(at))
                    if need > 0 and len(at):
                        rarest = at[np.lexsort((others[at], spread[at]))][: need + _MORE_ASKED]
                        asked.append((others[rarest], np.full(len(rarest), n), np.full(len(rarest), len(rarest) - need + 1)))
                    elif need > 0 and n - rule.least(n) + 1 > m:  # it emits too few
                        asked.append((np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)))
                if asked:
                    token, n, req = (np.concatenate(x) for x in zip(*asked, strict=True))
                    order = np.lexsort((n, token))
                    token, n, req = token[order], n[order], req[order]
                    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                    last = np.append(first[1:], len(token)) - 1
                    out.append([token[first], np.full(len(first), gid), n[first], n[last], np.minimum.reduceat(req, first)])
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([_signed(x.astype(np.int64)) for x in columns], names=["token", "gq", "ql", "qh", "req"])

    rows = groups.select("gid", "ns", "ms", "counts", "tokens").join(several, "gid")
    return mapped(rows, run, "token long, gq long, ql long, qh long, req long")


def meeting_groups(groups: DataFrame, rule: Rule, bag: list) -> DataFrame:
    """(lo, hi): the pairs of groups whose tokens allow a link, each once."""
    matrix = groups.select("gid", F.explode(F.arrays_zip("token", "low", "high")).alias("t")).select("gid", "t.token", "t.low", "t.high")
    spread = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    several = matrix.select("gid", "token").join(spread, "token").groupBy("gid").agg(F.collect_list(F.struct("token", "spread")).alias("t")).select("gid", F.col("t.token").alias("others"), F.col("t.spread").alias("spread"))
    alone = groups.where(F.exists(F.arrays_zip("ns", "ms"), lambda x: rule.asked(x["ns"]) > x["ms"])).select("gid")
    if alone.limit(1).count():
        several = several.join(alone, "gid", "full").select("gid", F.coalesce("others", F.array(F.lit(_LEAST))).alias("others"), F.coalesce("spread", F.array(F.lit(0).cast("long"))).alias("spread"))
    asked = written(_asking(groups, several, rule), "asked-tokens", bag=bag)
    fits = (F.col("low") <= F.col("qh")) & (F.col("high") * rule.den >= F.col("ql") * rule.num)
    met = asked.where("req > 0").join(matrix, "token").where((F.col("gid") != F.col("gq")) & fits)
    pairs = met.groupBy("gq", "gid").agg(F.count(F.lit(1)).alias("k"), F.min("req").alias("req")).where("k >= req").select("gq", "gid")
    wild = asked.where("req <= 0").groupBy("gq").agg(F.min("ql").alias("ql"), F.max("qh").alias("qh"))
    if (n_wild := wild.count()) > 0:
        sized = groups.select("gid", F.array_min("ns").alias("low"), F.array_max("ns").alias("high"))
        wild = F.broadcast(wild) if n_wild <= _BROADCAST_ROWS else wild
        pairs = pairs.union(sized.join(wild, (F.col("gid") != F.col("gq")) & fits).select("gq", "gid"))
    return written(pairs.select(F.least("gq", "gid").alias("lo"), F.greatest("gq", "gid").alias("hi")).distinct(), "open-pairs", bag=bag)


def member_sets(keyed: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(gid, cid, found) of the wanted (row_key, cls, check, gid, cid). Both class keys are verified; a task gives a class once in a while only."""
    if wanted.count() <= _BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = keyed.join(wanted, "row_key").select("gid", "cid", "cls", "check", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                out: list[tuple] = []
                numbers = zip(*(piece.column(c).to_pylist() for c in ("gid", "cid", "cls", "check")), strict=True)
                for (gid, cid, *keys), found in zip(numbers, shingle_sets(piece.column("text"), rule.n), strict=True):
                    if cid not in seen and len(found) and class_keys(found) == tuple(keys):
                        seen.add(cid)
                        out.append((gid, cid, found.tobytes()))
                if len(seen) > _FLUSH:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["gid", "cid", "found"])

    return mapped(rows, run, "gid long, cid long, found binary")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``a`` has in common with each of ``b``, by matrix products over blocks of tokens."""
    out = np.zeros((len(a), len(b)), np.float32)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])) for x in (a, b)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    places = []
    for tokens, rows in sides:
        at = np.minimum(np.searchsorted(both, tokens), max(0, len(both) - 1))
        real = both[at] == tokens if len(both) else np.zeros(len(tokens), bool)
        order = np.argsort(at[real], kind="stable")
        places.append((at[real][order], rows[real][order]))
    for low in range(0, len(both), _COLUMNS):
        parts = []
        for (at, rows), sets in zip(places, (a, b), strict=True):
            i, j = np.searchsorted(at, (low, low + _COLUMNS))
            part = np.zeros((len(sets), min(_COLUMNS, len(both) - low)), np.float32)
            part[rows[i:j], at[i:j] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def token_groups(sets: DataFrame, rule: Rule) -> DataFrame:
    """One row per group: gid, its members (cids, sizes, found), the token union, and each member's lead among the links inside."""
    together = sets.repartition("gid").sortWithinPartitions("gid", "cid")
    fields = [("gid", pa.int64()), ("cids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())), ("found", pa.binary()), ("tokens", pa.binary())]

    def group(gid: int, cids: list[int], found: list[np.ndarray]) -> list:
        sizes = np.array([len(x) for x in found])
        linked = np.argwhere(np.triu(rule.linked(_common(found, found), sizes, sizes), 1)) if len(cids) > 1 else np.zeros((0, 2), np.int64)
        whole = np.concatenate(found)
        return [gid, cids, sizes.tolist(), leads(cids, linked.tolist()), whole.tobytes(), np.unique(whole).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cids, found = None, [], []
        for batch in batches:
            done = []
            for gid, cid, raw in zip(*(batch.column(c).to_pylist() for c in ("gid", "cid", "found")), strict=True):
                if gid != now and cids:
                    done.append(group(now, cids, found))
                    cids, found = [], []
                now = gid
                if not cids or cids[-1] != cid:
                    cids.append(cid)
                    found.append(np.frombuffer(raw, np.uint64))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f[1]) for k, f in enumerate(fields)], names=[f[0] for f in fields])
        if cids:
            last = group(now, cids, found)
            yield pa.RecordBatch.from_arrays([pa.array([x], f[1]) for x, f in zip(last, fields, strict=True)], names=[f[0] for f in fields])

    return mapped(together, run, "gid long, cids array<long>, sizes array<long>, leads array<long>, found binary, tokens binary")


def _sets_of(raw: bytes, sizes: list[int]) -> list[np.ndarray]:
    return np.split(np.frombuffer(raw, np.uint64), np.cumsum(sizes)[:-1])


def qualifying(pairs: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """(lo, hi, some): the pairs where sets of ``hi`` (their positions) have enough tokens in the union of ``lo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, tokens, sizes, found in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "tokens", "sizes", "found")), strict=True):
                union, asked, sizes = np.frombuffer(tokens, np.uint64), np.frombuffer(found, np.uint64), np.array(sizes)
                at = np.minimum(np.searchsorted(union, asked), len(union) - 1)
                common = np.add.reduceat((union[at] == asked).astype(np.int64), np.cumsum(sizes) - sizes)
                some = np.flatnonzero(common >= rule.least(sizes))
                if len(some):
                    out.append((lo, hi, some.tolist()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["lo", "hi", "some"])

    unions = groups.select(F.col("gid").alias("lo"), "tokens")
    asking = groups.select(F.col("gid").alias("hi"), "sizes", "found")
    return mapped(pairs.join(unions, "lo").join(asking, "hi"), run, "lo long, hi long, some array<long>")


def opened(pairs: DataFrame, groups: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): for each qualifying pair a spanning forest of the links between the leads of its two groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("some", "sizes_lo", "found_lo", "leads_lo", "sizes_hi", "found_hi", "leads_hi")
        for batch in batches:
            a, b = [], []
            for some, n_lo, f_lo, l_lo, n_hi, f_hi, l_hi in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                left, right = _sets_of(f_lo, n_lo), _sets_of(f_hi, n_hi)
                right, l_right = [right[k] for k in some], np.array(l_hi)[some]
                at = np.argwhere(rule.linked(_common(left, right), np.array(n_lo), np.array(n_hi)[some]))
                links = np.unique(np.stack([np.array(l_lo)[at[:, 0]], l_right[at[:, 1]]], 1), axis=0) if len(at) else at
                ends, where = np.unique(links, return_inverse=True)
                for name, lead in zip(ends.tolist(), leads(ends.tolist(), where.reshape(-1, 2).tolist()), strict=True):
                    if lead != name:
                        a.append(name)
                        b.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def side(name: str) -> DataFrame:
        return groups.select(F.col("gid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("sizes", "found", "leads")))

    return mapped(pairs.join(side("lo"), "lo").join(side("hi"), "hi"), run, "a long, b long")


def linked_classes(keyed: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """(cid, label) of the candidates: classes of one component have one label."""
    bag: list[str] = []
    groups = written(similar_groups(candidates), "similar-groups", bag=bag)
    pairs = meeting_groups(groups, rule, bag)
    meeting = pairs.select(F.explode(F.array("lo", "hi")).alias("gid")).distinct().withColumn("meets", F.lit(True))
    needed = groups.join(meeting, "gid", "left").where(F.col("meets") | (F.size("cids") > 1))
    members = needed.select("gid", F.explode(F.arrays_zip("cids", "row_keys", "classes", "checks")).alias("r"))
    wanted = written(members.select("gid", F.col("r.cids").alias("cid"), F.col("r.row_keys").alias("row_key"), F.col("r.classes").alias("cls"), F.col("r.checks").alias("check")), "wanted", bag=bag)
    blobs = written(token_groups(member_sets(keyed, wanted, rule), rule), "token-groups", bag=bag)
    some = written(qualifying(pairs, blobs, rule), "qualifying", bag=bag)
    links = written(opened(some, blobs, rule), "links", bag=bag)
    labels = connected(links, bag)
    led = blobs.select(F.explode(F.arrays_zip("cids", "leads")).alias("r")).select(F.col("r.cids").alias("cid"), F.col("r.leads").alias("node"))
    named = candidates.select("cid").join(led, "cid", "left").withColumn("node", F.coalesce("node", "cid")).join(labels, "node", "left")
    out = written(named.select("cid", F.coalesce("label", "node").alias("label")), "labels")
    discard(keyed.sparkSession, bag)
    return out


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, slack: float = 7.0) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links of similarity num / den), kept.

    Of every component the rows of one (id, text) are kept, the smallest; rows without a shingle are all kept."""
    out = _components(_keyed(df, id_col, text_col), Rule(n, num, den, slack))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100, slack: float = 7.0) -> DataFrame:
    """The rows of ``df`` that ``ngram_components`` keeps, with all their columns, whatever their names."""
    found = _components(_keyed(df, id_col, text_col), Rule(n, num, den, slack)).where("kept")
    own, kept = free_name(df, "own_key"), free_name(df, "kept_key")
    rows = df.withColumn(own, _row_key(F.col(id_col), F.col(text_col)))
    stay = found.select(F.col("row_key").alias(kept)).distinct()
    return rows.join(stay, F.col(own) == F.col(kept), "left_semi").drop(own)


def _components(keyed: DataFrame, rule: Rule) -> DataFrame:
    """(id, row_key, n_shingles, component_id, kept)."""
    spark, bag = keyed.sparkSession, []
    docs = written(document_sets(keyed, rule), "document-sets")
    first_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("first")
    classes = docs.where("cls IS NOT NULL").groupBy("cls", "check").agg(*(F.first(c).alias(c) for c in ("n", "m", "top", "below")), first_row, F.count(F.lit(1)).alias("copies"))
    classes = classes.select("*", F.col("first.id").alias("least_id"), F.col("first.row_key").alias("row_key"))
    classes = written(classes, "classes")
    emitted, n_rows = classes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    n_ranges = 1 << max(8, min(22, math.ceil(math.log2(emitted / _RANGE_TOKENS + 1))))
    shared = written(shared_tokens(keyed, rule, n_ranges), "shared-tokens", bag=bag)
    candidates = written(candidate_classes(classes, shared, rule), "candidates")
    discard(spark, bag)
    labels = linked_classes(keyed, candidates, rule)
    labelled = candidates.select("cls", "check", "cid", "first").join(labels, "cid")
    least = labelled.groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    changed = labelled.join(_small(least), "label").select("cls", "check", "least")
    by_class = classes.select("cls", "check", "first", "copies").join(_small(changed), ["cls", "check"], "left")
    by_class = by_class.where("copies > 1 OR least IS NOT NULL").select("cls", "check", "copies", F.coalesce("least", "first").alias("least"))
    out = _with_classes(docs, written(by_class, "by-class"), n_rows)
    alone = F.col("least").isNull()
    return out.select("id", "row_key", F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), (alone | (F.col("row_key") == F.col("least.row_key"))).alias("kept"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its size allows."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def _with_classes(docs: DataFrame, by_class: DataFrame, n_rows: int) -> DataFrame:
    """``docs`` with ``least`` of their classes, null for those that are their class's only row and link with nothing.

    Few classes are broadcast; of many, those with very many rows are, whose rows then are not shuffled."""
    keys = ["cls", "check"]
    if by_class.count() <= _BROADCAST_ROWS:
        return docs.join(F.broadcast(by_class.drop("copies")), keys, "left")
    common = F.col("copies") > max(_COMMON_ROWS, n_rows // _COMMON_CLASSES)  # so many classes at most, whatever the table
    hot = F.broadcast(by_class.where(common).drop("copies"))
    rest = docs.join(hot.drop("least"), keys, "left_anti").join(by_class.where(~common).drop("copies"), keys, "left")
    return rest.unionByName(docs.join(hot, keys))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)

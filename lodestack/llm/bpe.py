"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so it
marks a certain cut: the pieces between such cuts are encoded on their own and their
ids concatenated. The last byte of a word carries the vocabulary's word-end mark and
counts as a symbol of its own. Merging a piece takes the lowest rank first, leftmost
first. Short pieces make their merges together in numpy tables; long ones use a heap,
so a word of any length costs n log n.

White space ends a word, so ids are kept by white-space-delimited chunk in a bounded
dictionary. Characters outside ``_PLAIN`` go through the vocabulary file's own
normalizer and pre-tokenizer, whose Unicode tables may differ from Python's.

Defined results: null text encodes as the empty text, to no ids; extra columns are
ignored; rows stay in their partition, one out for each one in.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import map_arrow

_PLAIN = re.compile("[\x00-˿Ͱ-ͳΆ-ϿЀ-҂Ҋ-ӿ‐-‧‰-⁞₠-₿]*")
#: Fixed by the vocabulary file's format: its pre-tokenizer's pattern, with white space spelled out.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+")
_END = "</w>"
#: Bytes of text encoded together: chunks that repeat among them are looked up once.
ENCODE_BYTES = 4 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


class Recent:
    """A bounded dictionary of two generations: what was asked for lately outlives a change of generation."""

    def __init__(self, limit: int, longest: int = 64):
        self.young: dict = {}
        self.old: dict = {}
        self.limit, self.longest = limit, longest

    def find(self, key: str | bytes) -> bytes | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.keep(key, got)
        return got

    def keep(self, key: str | bytes, value: bytes) -> bytes:
        if len(key) <= self.longest:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = value
        return value

    def find_all(self, keys: list) -> list:
        got = list(map(self.young.get, keys))
        if self.old:
            for k in [k for k, v in enumerate(got) if v is None]:
                if (v := self.old.get(keys[k])) is not None:
                    got[k] = self.keep(keys[k], v)
        return got


class Known:
    """The ids of chunks met lately, in arrays: found by one hash join for all chunks of a batch.

    Beyond ``limit`` chunks, the half that was asked for last stays."""

    def __init__(self, limit: int, longest: int = 64):
        self.limit, self.longest, self.now = limit, longest, 0
        self.keys = pa.array([], pa.string())
        self.values = np.zeros(0, "<u4")
        self.begins = self.sizes = self.used = np.zeros(0, np.int64)

    def find(self, chunks: pa.Array) -> np.ndarray:
        """The place of each chunk, -1 for those not known."""
        self.now += 1
        at = pc.fill_null(pc.index_in(chunks, value_set=self.keys), -1).to_numpy(zero_copy_only=False)
        self.used[at[at >= 0]] = self.now
        return at

    def add(self, chunks: pa.Array, values: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps new chunks, with their ids one after another; long ones are not kept."""
        begins = np.cumsum(sizes) - sizes + len(self.values)
        short = np.flatnonzero(pc.binary_length(chunks).to_numpy(zero_copy_only=False) <= self.longest)
        self.keys = pa.concat_arrays([self.keys, chunks.take(pa.array(short))])
        self.values = np.concatenate([self.values, values])
        self.begins = np.concatenate([self.begins, begins[short]])
        self.sizes = np.concatenate([self.sizes, sizes[short]])
        self.used = np.concatenate([self.used, np.full(len(short), self.now)])
        if len(self.keys) > self.limit:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2])
            self.values = gathered_ids(self.values, self.begins[stay], self.sizes[stay])[0]
            self.keys, self.sizes, self.used = self.keys.take(pa.array(stay)), self.sizes[stay], self.used[stay]
            self.begins = np.cumsum(self.sizes) - self.sizes


def gathered_ids(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` one after another, and where each begins (one more than runs)."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])], ends


class WordBpe:
    """Encoder and decoder for a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.vocab = path, model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.inside = self._inside_pairs()
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._merge_tables()
        self._library = None
        self._pieces = Recent(cache_entries // 8)
        self._chunks = Known(cache_entries)

    def _inside_pairs(self) -> np.ndarray:
        """[a, b]: whether byte b follows byte a inside some token; 256 + b is byte b at a word's end."""
        code = {c: b for b, c in enumerate(self.letters)}
        found = np.zeros((512, 512), bool)
        for token in self.vocab:
            codes = [code[c] for c in token.removesuffix(_END)]
            if token.endswith(_END) and codes:
                codes[-1] += 256
            found[codes[:-1], codes[1:]] = True
        return found

    def fragments(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Pieces of all words between certain cuts, and the number of pieces of each word.

        A word's last piece ends with byte 255, which UTF-8 never has."""
        joined = b"\xff".join(words) + b"\xff"
        raw = np.frombuffer(joined, np.uint8)
        ends = np.flatnonzero(raw == 255)
        codes = raw.astype(np.int64)
        codes[ends - 1] += 256
        cut = np.zeros(len(raw), bool)
        cut[1:] = ~self.inside[codes[:-1] & 511, codes[1:] & 511]
        cut[ends] = False
        cut[0] = True
        cut[ends[:-1] + 1] = True
        at = np.flatnonzero(cut)
        edges = [*at.tolist(), len(raw)]
        pieces = [joined[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        return pieces, np.diff(np.searchsorted(at, [0, *(ends + 1)]))

    def _merge_tables(self) -> None:
        """Symbols of bytes, and all merges sorted by their pair of ids."""
        vocab = self.vocab
        self._symbol = np.array([vocab[c] for c in self.letters] + [vocab[c + _END] for c in self.letters], np.int64)
        pairs = np.array([(vocab[a] << 32 | vocab[b], r, vocab[a + b]) for (a, b), r in self.ranks.items()], np.int64).reshape(-1, 3)
        order = np.argsort(pairs[:, 0])
        self._pair_keys, self._pair_ranks = pairs[order, 0], pairs[order, 1]
        self._product = np.zeros(len(pairs) and int(pairs[:, 1].max()) + 1, np.int64)
        self._product[pairs[:, 1]] = pairs[:, 2]

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._pair_keys, keys), len(self._pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self._pair_keys[at] == keys), self._pair_ranks[at], len(self._product))

    def _merge_many(self, keys: list[bytes]) -> list[bytes]:
        """Merges many pieces together: in each step every piece makes its next merge."""
        sizes = np.fromiter(map(len, keys), np.int64, len(keys))
        out: list[bytes] = [b""] * len(keys)
        for low, high in ((0, 5), (5, 9), (9, 14), (14, 26)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                for k, ids in zip(rows.tolist(), self._merge_table([keys[k] for k in rows], sizes[rows]), strict=True):
                    out[k] = ids
        for k in np.flatnonzero(sizes > 26).tolist():
            symbols = [self.letters[b] for b in keys[k] if b != 255]
            if keys[k][-1] == 255:
                symbols[-1] += _END
            out[k] = array("I", self._merge(symbols)).tobytes()
        return list(map(self._pieces.keep, keys, out))

    def _merge_table(self, keys: list[bytes], sizes: np.ndarray) -> list[bytes]:
        raw = np.frombuffer(b"".join(keys), np.uint8)
        marks = np.flatnonzero(raw == 255)
        codes = raw.astype(np.int64)
        codes[marks - 1] += 256
        row = np.repeat(np.arange(len(keys)), sizes)
        column = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.full((len(keys), int(sizes.max()) + 1), -1, np.int64)
        real = raw != 255
        table[row[real], column[real]] = self._symbol[codes[real]]
        never = len(self._product)
        ranks = self._rank_of(table[:, :-1], table[:, 1:])
        columns = np.arange(ranks.shape[1])
        left = np.arange(len(keys))
        while len(left):
            at = ranks.argmin(1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            some = best < never
            left, ranks, at, best = left[some], ranks[some], at[some], best[some]
            if not len(left):
                break
            now = table[left]
            gone = columns[None, :] > at[:, None]
            now[:, :-1] = np.where(gone, now[:, 1:], now[:, :-1])
            now[:, -1] = -1
            rows = np.arange(len(left))
            now[rows, at] = self._product[best]
            table[left] = now
            ranks[:, :-1] = np.where((columns >= at[:, None])[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = never
            ranks[rows, at] = self._rank_of(now[rows, at], now[rows, at + 1])
            inner = at > 0
            ranks[rows[inner], at[inner] - 1] = self._rank_of(now[rows[inner], at[inner] - 1], now[rows[inner], at[inner]])
        kept = table >= 0
        data = table[kept].astype("<u4").tobytes()
        edges = [0, *(4 * np.cumsum(kept.sum(1))).tolist()]
        return [data[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def _merge(self, symbols: list[str]) -> tuple[int, ...]:
        """Lowest rank first, then leftmost, over a linked list."""
        parts: list[str | None] = list(symbols)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def _words(self, part: str) -> list[bytes]:
        """Words of ``part``, normalised, in UTF-8."""
        if _PLAIN.fullmatch(part):
            low = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            return [w.encode() for w in _WORD.findall(low)]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._code = {c: b for b, c in enumerate(self.letters)}
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part))
        return [bytes(map(self._code.__getitem__, w)) for w, _ in found]

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks not known yet."""
        words: list[bytes] = []
        counts, special = [], {}
        for k, (chunk, low) in enumerate(zip(chunks, "\n".join(chunks).lower().split("\n"), strict=True)) if chunks else ():
            before = len(words)
            if low.isalpha() and (chunk.isascii() or max(chunk) < "\u0250"):
                words.append(low.encode())
            elif self._special and "<" in chunk and (parts := self._special.split(chunk))[1:]:
                special[k] = parts
            else:
                words.extend(self._words(chunk))
            counts.append(len(words) - before)
        out = [b""] * len(chunks)
        if words:
            pieces, per_word = self.fragments(words)
            ids = self._pieces.find_all(pieces)
            missing = [p for p, got in zip(pieces, ids, strict=True) if got is None]
            distinct = list(dict.fromkeys(missing))
            made = dict(zip(distinct, self._merge_many(distinct), strict=True))
            ids = [made[p] if got is None else got for p, got in zip(pieces, ids, strict=True)]
            edges = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            out = [ids[i] if j == i + 1 else b"".join(ids[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
        for k, parts in special.items():
            out[k] = b"".join(array("I", (self.special[p],)).tobytes() if p in self.special else b"".join(self._encode_chunks([p])) for p in parts if p)
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (one more than texts).

        Each distinct chunk of the batch is looked up once; ids are then gathered by numpy."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        known, places = self._chunks, self._chunks.find(coded.dictionary)
        missing = np.flatnonzero(places < 0)
        unknown = coded.dictionary.take(pa.array(missing))
        made = self._encode_chunks(unknown.to_pylist())
        fresh, lengths = np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4
        begins, sizes = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
        old = places >= 0
        begins[old], sizes[old] = known.begins[places[old]], known.sizes[places[old]]
        begins[missing], sizes[missing] = np.cumsum(lengths) - lengths + len(known.values), lengths
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = gathered_ids(np.concatenate([known.values, fresh]), begins[at], sizes[at])
        known.add(unknown, fresh, lengths)
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, ends[edges]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids) -> str:
        """The file names no decoder: tokens, special ones too, joined by spaces; unknown ids are skipped."""
        tokens, top = self.tokens, len(self.tokens)
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except IndexError:
            return " ".join(tokens[i] for i in ids if i < top)


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array whose items are the values between the edges."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: the id column and ``ids``, little-endian unsigned 32-bit integers."""
    path = vocabulary or default_vocabulary()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encode = tokenizer(path).encode_batch

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = binaries(*encode(batch.column("text")))
            return pa.RecordBatch.from_arrays([batch.column("id"), ids], names=["id", "ids"])

        return each

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, make, f"id {kind}, ids binary", "text", ENCODE_BYTES).withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Appends ``out_col``, the decoded text of ``ids_col``; a column of that name is replaced."""
    path = vocabulary or default_vocabulary()
    rows = df.drop(out_col) if out_col != ids_col else df
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        decode = tokenizer(path).decode

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array([decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column(ids_col).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out_col])

        return each

    return map_arrow(rows, make, f"{fields}, `{out_col}` string", ids_col)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    both = decode_documents(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )

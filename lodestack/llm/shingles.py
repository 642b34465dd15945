"""Word shingles as 64-bit hashes, by numpy over whole batches of texts.

Words are maximal runs of other bytes than white space, A-Z lower-cased. A word's hash
is a polynomial of its bytes taken from running sums; a shingle's hash mixes its words'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        got = _powers[name] = np.multiply.accumulate(steps)
    return got[:n]


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that lie one after another, and the number of words of each.

    ``begins`` has one more entry than texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(begins) - 1, np.int64)
    inside = ~_SPACE[raw]
    opens = np.zeros(n + 1, bool)
    opens[begins] = True
    before = np.concatenate([[False], inside[:-1]]) & ~opens[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~opens[1:]
    ends = np.flatnonzero(inside & ~after)
    sums = np.cumsum(_LETTERS[_LOWER[raw]] * _power("up", _BASE, n))
    low = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    hashes = mixed((sums[ends] - low) * _power("down", _INVERSE, n)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, begins))


def _segments(raw: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Cuts a long text at white space."""
    while b - a > _SEGMENT:
        cut = a + _SEGMENT
        while cut < b and not _SPACE[raw[cut]]:
            cut += 1
        yield a, cut
        a = cut
    yield a, b


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words the whole is one shingle."""
    values = texts.fill_null("")
    buffers = values.buffers()
    wide = pa.types.is_large_string(values.type)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2] or b"", np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    k = 0
    while k < len(values):
        j = k + 1
        while j < len(values) and offsets[j + 1] - offsets[k] <= _SEGMENT:
            j += 1
        if j == k + 1 and offsets[j] - offsets[k] > _SEGMENT:
            parts = [word_hashes(raw[a:b], np.array([0, b - a]))[0] for a, b in _segments(raw, offsets[k], offsets[j])]
            words, counts = np.concatenate(parts), np.array([sum(map(len, parts))])
        else:
            words, counts = word_hashes(raw[offsets[k] : offsets[j]], offsets[k : j + 1] - offsets[k])
        out += _sets(words, counts, n)
        k = j
    return out


def _sets(words: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    factors = mixed(np.arange(11, 11 + n, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    total = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(total) else 0):
        total += words[k : k + len(total)] * factors[k]
    total = mixed(total)
    out, at = [], 0
    for count in counts.tolist():
        if count >= n:
            found = np.sort(total[at : at + count - n + 1])
            if len(found) > 1:
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif count:
            found = mixed((words[at : at + count] * factors[:count]).sum(keepdims=True) + np.uint64(count))
        else:
            found = np.zeros(0, np.uint64)
        out.append(found)
        at += count
    return out


def class_keys(found: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set, from two independent sums over its mixed members and their number."""
    first = mixed(found + np.uint64(0x51)).sum()
    second = mixed(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    both = mixed(np.array([first, second], np.uint64) * np.uint64(3) + np.uint64(len(found)))
    turned = mixed(np.array([both[0] + (both[1] << np.uint64(1)), (both[0] << np.uint64(1)) + both[1] * np.uint64(_BASE)], np.uint64))
    key, check = turned.view(np.int64).tolist()
    return key, check

"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAVE containers.

Companded samples expand by lookup tables built from their rule. ADPCM blocks are
independent, so all blocks of a file step through their samples together, one numpy
call for each sample position. Decoded audio is resampled by linear interpolation and
stored as 16-bit PCM.

Any bytes can be stored losslessly as 8-bit companded samples: ``store_bytes`` pads
them with zero bytes to a positive multiple of 64. Defined results: null is the empty
text, stored as 64 zero bytes. Extra columns are ignored, and equal texts give equal
values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import map_arrow

#: Format tags of WAVE files.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
UNIT = 64
RATE = 8000
BLOCK = 256  # bytes of an ADPCM block
#: Step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


_EXPAND = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def wave(tag: int, rate: int, data: bytes, block: int = 1, bits: int = 8, samples: int | None = None, per_block: int | None = None) -> bytes:
    """A mono WAVE file."""
    extra = b"" if per_block is None else struct.pack("<H", per_block)
    bytes_per_second = rate * block if per_block is None else rate * block // per_block
    form = struct.pack("<HHIIHHH", tag, 1, rate, bytes_per_second, block, bits, len(extra)) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) if samples is None else samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(raw: bytes) -> dict:
    """Format fields and the bytes of the data chunk."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE" or struct.unpack_from("<I", raw, 4)[0] + 8 != len(raw):
        raise ValueError("not a whole WAVE file")
    at, out = 12, {"samples": None, "per_block": None}
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        begin = at + 8
        if begin + size > len(raw):
            raise ValueError("cut chunk")
        if name == b"fmt ":
            out["tag"], out["channels"], out["rate"], _, out["block"], out["bits"] = struct.unpack_from("<HHIIHH", raw, begin)
            if size >= 20:
                out["per_block"] = struct.unpack_from("<H", raw, begin + 18)[0]
        elif name == b"fact":
            out["samples"] = struct.unpack_from("<I", raw, begin)[0]
        elif name == b"data":
            out["data"] = raw[begin : begin + size]
        at = begin + size + (size & 1)
    if "tag" not in out or "data" not in out:
        raise ValueError("no format or no data")
    return out


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """Samples of all whole blocks, of one file or of several; blocks advance together."""
    raw = np.frombuffer(data, np.uint8)
    blocks = raw[: len(raw) // block * block].reshape(-1, block)
    if not len(blocks):
        return np.zeros(0, np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], 2).reshape(len(blocks), -1)
    out = np.empty((len(blocks), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code = codes[:, k].astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def encode_adpcm(samples: np.ndarray, block: int = 256) -> bytes:
    """The nearest codes, block by block together; the last block repeats the last sample."""
    return encode_adpcm_files([samples], block)[0]


def encode_adpcm_files(files: list[np.ndarray], block: int = BLOCK) -> list[bytes]:
    """``encode_adpcm`` of several files, the blocks of all of them together."""
    width = (block - 4) * 2 + 1
    counts = [max(1, -(-len(f) // width)) for f in files]
    whole = [np.pad(f.astype(np.int32), (0, n * width - len(f)), mode="edge" if len(f) else "constant") for f, n in zip(files, counts, strict=True)]
    data = _encode_blocks(np.concatenate(whole).reshape(-1, width)) if files else b""
    ends = block * np.cumsum([0, *counts])
    return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def _encode_blocks(padded: np.ndarray) -> bytes:
    n, width = padded.shape
    value, index = padded[:, 0].copy(), np.zeros(n, np.int32)
    codes = np.zeros((n, width - 1), np.uint8)
    for k in range(width - 1):
        gap, step = padded[:, k + 1] - value, STEPS[index]
        size = np.abs(gap)
        code = np.where(gap < 0, 8, 0)
        change = step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = size >= part
            code, size, change = code | np.where(hit, bit, 0), size - np.where(hit, part, 0), change + np.where(hit, part, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + CHANGES[code], 0, 88)
        codes[:, k] = code
    head = np.zeros((n, 4), np.uint8)
    head[:, :2] = padded[:, :1].astype("<i2").view(np.uint8)
    return np.hstack([head, codes[:, ::2] | codes[:, 1::2] << 4]).astype(np.uint8).tobytes()


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """(16-bit samples, rate) of a WAVE file of any of the four formats."""
    x = read_wave(raw)
    if x["tag"] in _EXPAND:
        samples = _EXPAND[x["tag"]][np.frombuffer(x["data"], np.uint8)]
    elif x["tag"] == IMA_ADPCM:
        samples = decode_adpcm(x["data"], x["block"])
    elif x["tag"] == PCM and x["bits"] == 16:
        samples = np.frombuffer(x["data"][: len(x["data"]) & ~1], "<i2")
    else:
        raise ValueError(f"format {x['tag']} is not known")
    return samples[: x["samples"]] if x["samples"] is not None and x["tag"] != PCM else samples, x["rate"]


def resample(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample stands beyond the end."""
    if source == target or not len(samples):
        return samples.astype(np.int16)
    if target == 2 * source:
        out = np.empty(2 * len(samples), np.int16)
        out[::2] = samples
        wide = samples.astype(np.int32)
        out[1:-1:2] = wide[:-1] + wide[1:] >> 1
        out[-1] = samples[-1]
        return out
    n = max(1, len(samples) * target // source)
    place = np.arange(n, dtype=np.int64) * source
    low, part = place // target, place % target
    wide = np.append(samples, samples[-1]).astype(np.int64)
    return ((wide[low] * (target - part) + wide[low + 1] * part) // target).astype(np.int16)


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, sign changes, sum of sizes and sum of squares."""
    wide = pcm.astype(np.int64)
    changes = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{len(pcm)}:{int(np.abs(wide).max(initial=0))}:{changes}:{int(np.abs(wide).sum())}:{int(wide @ wide)}"


def store_bytes(payload: bytes, tag: int = MU_LAW, rate: int = RATE) -> bytes:
    """Bytes as companded samples, zero-padded to a positive multiple of ``UNIT``."""
    size = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return wave(tag, rate, payload.ljust(size, b"\0"))


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: int = MU_LAW) -> DataFrame:
    """(id, n_bytes, media): texts stored as WAVE files of companded samples."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    kind = rows.schema["id"].dataType.simpleString()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = batch.column("raw").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, raws), pa.int64()), pa.array([store_bytes(r, tag) for r in raws], pa.binary())], names=["id", "n_bytes", "media"])

        return each

    return map_arrow(rows, make, f"id {kind}, n_bytes long, media binary", "raw").withColumnRenamed("id", id_col)


def decoded_column(df: DataFrame, media_col: str = "media", rate: int = 2 * RATE) -> DataFrame:
    """Replaces ``media_col`` by 16-bit PCM WAVE files at ``rate``; all other columns stay."""
    return convert_column(df, "pcm", media_col, rate=rate)


def as_pcm(media: list[bytes], rate: int) -> list[bytes]:
    """16-bit PCM files at ``rate`` of files of any format; ADPCM blocks of all files are decoded together."""
    found = [read_wave(m) for m in media]
    joint: dict[int, list[int]] = {}
    for k, x in enumerate(found):
        if x["tag"] == IMA_ADPCM:
            joint.setdefault(x["block"], []).append(k)
    samples: dict[int, np.ndarray] = {}
    for block, files in joint.items():
        whole = [found[k]["data"][: len(found[k]["data"]) // block * block] for k in files]
        decoded = decode_adpcm(b"".join(whole), block)
        ends = np.cumsum([0, *(len(w) // block * ((block - 4) * 2 + 1) for w in whole)])
        samples |= {k: decoded[i:j][: found[k]["samples"]] for k, i, j in zip(files, ends, ends[1:], strict=False)}
    out = []
    for k, x in enumerate(found):
        sound = samples[k] if k in samples else decode(media[k])[0]
        out.append(wave(PCM, rate, resample(sound, x["rate"], rate).astype("<i2").tobytes(), 2, 16))
    return out


def as_adpcm(media: list[bytes]) -> list[bytes]:
    """ADPCM files of files of any format, at their own rates; blocks of all files are encoded together."""
    sounds = [decode(m) for m in media]
    made = encode_adpcm_files([s for s, _ in sounds], BLOCK)
    return [wave(IMA_ADPCM, rate, data, BLOCK, 4, len(s), (BLOCK - 4) * 2 + 1) for data, (s, rate) in zip(made, sounds, strict=True)]


def convert_column(df: DataFrame, to: str, media_col: str = "media", out_col: str | None = None, rate: int = 2 * RATE) -> DataFrame:
    """Appends ``out_col`` (or replaces ``media_col``): its files as ``pcm`` at ``rate`` or as ``adpcm``; nulls stay null."""
    name = out_col or media_col
    rows = df if name == media_col else df.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != name)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            files = batch.column(media_col).to_pylist()
            real = [k for k, m in enumerate(files) if m is not None]
            made = as_pcm([files[k] for k in real], rate) if to == "pcm" else as_adpcm([files[k] for k in real])
            out: list[bytes | None] = [None] * len(files)
            for k, m in zip(real, made, strict=True):
                out[k] = m
            names = [n for n in batch.schema.names if n != name]
            return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, name])

        return each

    return map_arrow(rows, make, f"{fields}, `{name}` binary", media_col)


def describe_column(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", more: tuple[str, ...] = ()) -> DataFrame:
    """Reads the stored files back: sizes, digests and features of the decoded, resampled audio.

    Of every column of ``more``: the size, the digest and the feature of its file as it is stored."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    extra = [f"{m}_{n}" for m in more for n in ("bytes", "sha256", "feature")]

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(raw: bytes) -> tuple:
            payload = read_wave(raw)["data"]
            samples, rate = decode(raw)
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(resample(samples, rate, 2 * rate))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*map(one, batch.column("media").to_pylist()), strict=True)] or [[]] * len(names)
            for m in more:
                files = batch.column(m).to_pylist()
                sounds = [decode(p)[0] for p in as_pcm(files, 2 * RATE)]
                columns += [[len(f) for f in files], [hashlib.sha256(f).hexdigest() for f in files], [feature(s) for s in sounds]]
            all_kinds = kinds + [pa.int64(), pa.string(), pa.string()] * len(more)
            arrays = [pa.array(c, k) for c, k in zip(columns, all_kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *arrays], names=["id", "n_bytes", *names, *extra])

        return each

    rows = df.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media"), *more)
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += "".join(f", {n} {'long' if n.endswith('_bytes') else 'string'}" for n in extra)
    return map_arrow(rows, make, schema, "media").withColumnRenamed("id", id_col)


def op9_media(spark, sf_dir: str) -> DataFrame:
    """The stored mu-law files described, and beside them what is stored of the same audio as ADPCM and as resampled PCM decoded from that."""
    stored = media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    both = convert_column(convert_column(stored, "adpcm", out_col="adpcm"), "pcm", "adpcm", "pcm")
    return describe_column(both, more=("adpcm", "pcm"))

"""Media columns: telephony audio in WAV containers, decoded with numpy and kept as resampled PCM.

mu-law and A-law expand by look-up tables of 256 samples. IMA ADPCM blocks decode together: the loop runs over the
samples of a block, each step a numpy operation across all blocks. Resampling is a windowed sinc over the phases of the
two rates' ratio, in a fixed order of additions, so equal input gives equal output.

Null content has status "null" and no samples; content that isn't a WAV file, or is of a kind not listed in CODECS or
of several channels, has status "unsupported" and no samples; a data chunk that ends early is decoded as far as it goes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.columns import slices
from gleanery.session import materialise

#: WAVE format tags.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
CODECS = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA: "ima_adpcm"}

#: The step sizes of IMA ADPCM and how an index moves with a code's three low bits.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)

RATE, TARGET_RATE = 8_000, 16_000
UNIT = 576
TAPS = 16


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, base = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part == 0, base, (base + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_SAMPLES, ALAW_SAMPLES = mulaw_table(), alaw_table()


def ima_moves() -> tuple[np.ndarray, np.ndarray]:
    """For every (index, code): the signed change of the sample, and the next index."""
    step, code = IMA_STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    following = np.clip(np.arange(len(IMA_STEPS))[:, None] + IMA_MOVES[code & 7], 0, len(IMA_STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


IMA_CHANGE, IMA_NEXT = ima_moves()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x samples) of an array (blocks x bytes) of mono IMA ADPCM blocks."""
    count, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), count), dtype=np.int16)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out[0] = sample
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for i, column in enumerate(columns):
        for k, code in enumerate((column & 15, column >> 4)):
            index += code
            sample += IMA_CHANGE[index]
            np.clip(sample, -32768, 32767, out=sample)
            index = IMA_NEXT[index]
            out[1 + 2 * i + k] = sample
    return out.T


def resample(samples: np.ndarray, rate: int, target: int, taps: int = TAPS) -> np.ndarray:
    """16-bit samples at the target rate."""
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    common = gcd(rate, target)
    up, down = target // common, rate // common
    cutoff = min(1.0, up / down)
    reach = max(taps // 2, int(np.ceil(taps / 2 / cutoff)))
    padded = np.concatenate([np.zeros(reach, np.float32), samples.astype(np.float32), np.zeros(reach + 1, np.float32)])
    total = -(-len(samples) * up // down)
    out = np.empty(total, dtype=np.float32)
    for phase in range(min(up, total)):
        base, part = phase * down // up, phase * down % up / up
        count = -(-(total - phase) // up)
        offset = np.arange(-reach + 1, reach + 1) - part
        kernel = cutoff * np.sinc(cutoff * offset) * (0.5 + 0.5 * np.cos(np.pi * offset / (reach + 1)))
        kernel = (kernel / kernel.sum()).astype(np.float32)
        value = np.zeros(count, np.float32)
        for k, weight in enumerate(kernel):
            if abs(weight) > 1e-7:
                value += weight * padded[base + k + 1 :: down][:count]
        out[phase::up] = value
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def write_wav(data: bytes, tag: int, rate: int, bits: int, align: int = 1) -> bytes:
    """A mono WAV file of one data chunk."""
    extra = b"" if tag == PCM else struct.pack("<HH", 2, 1 + 2 * (align - 4)) if tag == IMA else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * align, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(raw: bytes) -> tuple[int, int, int, int, int, bytes]:
    """Tag, channels, rate, block size, bits and data of a WAV file; ValueError if it is none."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = raw[at + 8 : at + 8 + size]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if form is None or data is None or len(form) < 16:
        raise ValueError("no format or no data")
    tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", form)
    return tag, channels, rate, align, bits, data


def decode_wav(raw: bytes) -> tuple[str, int, np.ndarray]:
    """Codec, rate and samples of a WAV file; ValueError for what isn't supported."""
    tag, channels, rate, align, bits, data = read_wav(raw)
    if tag not in CODECS or channels != 1 or not rate:
        raise ValueError("codec or channels not supported")
    if tag == IMA:
        if align <= 4 or len(data) < align:
            return CODECS[tag], rate, np.zeros(0, np.int16)
        whole = np.frombuffer(data, np.uint8, len(data) // align * align).reshape(-1, align)
        return CODECS[tag], rate, decode_ima(whole).reshape(-1)
    if tag == PCM and bits == 16:
        return CODECS[tag], rate, np.frombuffer(data, "<i2", len(data) // 2).astype(np.int16)
    if tag == PCM and bits != 8:
        raise ValueError("bits not supported")
    codes = np.frombuffer(data, np.uint8)
    if tag == PCM:
        return CODECS[tag], rate, ((codes.astype(np.int16) - 128) << 8).astype(np.int16)
    return CODECS[tag], rate, (MULAW_SAMPLES if tag == MULAW else ALAW_SAMPLES)[codes]


def store_pcm(media: DataFrame, key: str = "media_id", content: str = "content", rate: int = TARGET_RATE) -> DataFrame:
    """key, status, codec, rate, n_samples and pcm (a 16-bit WAV file at the given rate) of every row."""
    source = media.select(media[key], media[content])
    names = [key, "status", "codec", "rate", "n_samples", "pcm"]

    def one(raw: bytes | None):
        if raw is None:
            return "null", None, None, None, None
        try:
            codec, own, samples = decode_wav(raw)
        except ValueError:
            return "unsupported", None, None, None, None
        out = resample(samples, own, rate)
        return "ok", codec, rate, len(out), write_wav(out.astype("<i2").tobytes(), PCM, rate, 16, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            rows = [one(x) for x in part.column(1).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, status string, codec string, rate int, n_samples long, pcm binary")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's bytes, filled up with 255 to a positive multiple of UNIT, and their number before that."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def level(samples: np.ndarray) -> int:
    return int(np.abs(samples.astype(np.int32)).sum(dtype=np.int64) // max(1, samples.size))


def feature_of(codes: np.ndarray, adpcm: np.ndarray) -> str:
    """Level, peak and sign changes of the mu-law samples, level as A-law and as ADPCM, and the check sum of the resampled PCM."""
    samples = MULAW_SAMPLES[codes]
    signs = int(np.count_nonzero(np.diff(samples < 0)))
    pcm = resample(samples, RATE, TARGET_RATE)
    return (f"level={level(samples)};peak={int(np.abs(samples.astype(np.int32)).max(initial=0))};changes={signs};"
            f"alaw={level(ALAW_SAMPLES[codes])};adpcm={level(adpcm)};pcm16k={zlib.crc32(pcm.astype('<i2').tobytes()):08x}")


def audio_of_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and content of every row: the text's payload as the mu-law samples of a WAV file."""
    source = docs.select(docs[key], docs[text])
    names = [key, "n_bytes", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            sizes, payloads = zip(*map(payload_of, part.column(1).to_pylist()), strict=True)
            files = [write_wav(p, MULAW, RATE, 8) for p in payloads]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names)

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, n_bytes long, content binary")


def described(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digests and features of media rows (key, n_bytes, content) that audio_of_texts made."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, 1 << 20):
            files = part.column(2).to_pylist()
            back = [np.frombuffer(read_wav(f)[5], np.uint8) for f in files]
            adpcm = decode_ima(np.concatenate(back).reshape(-1, UNIT))
            ends = np.cumsum([0, *(len(b) // UNIT for b in back)])
            columns = [
                part.column(1), pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]), pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                pa.array([feature_of(b, adpcm[ends[i] : ends[i + 1]]) for i, b in enumerate(back)]),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    kind = media.schema[key].dataType.simpleString()
    return media.mapInArrow(run, f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def texts_as_audio(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored without loss as 8-bit mu-law samples of WAV files, read back from the table of these and described.

    media_bytes and media_sha256 are of the stored file; the payload's digests are of the bytes read back. The feature
    takes the payload as mu-law, as A-law and as ADPCM blocks of UNIT bytes, and has the check sum of the resampled PCM.
    That PCM itself, four bytes for each of the payload's, is what store_pcm() keeps of such a table. A null text is the
    empty one; an empty table gives an empty result.
    """
    return described(materialise(audio_of_texts(docs, key, text), "media", compression="zstd"), key)

"""Telephony audio columns: bytes stored as 8-bit companded samples, and read back into features and PCM.

store: a text's UTF-8 bytes, padded with 255 up to a positive multiple of 576 (16 ADPCM blocks), become the samples of a mono
8 kHz mu-law WAVE file, byte for byte.
expand: parses the stored file, and from its samples alone gives the payload's digests and what three decoders hear in it:
mu-law and A-law by 256-entry tables, and IMA ADPCM in blocks of 36 bytes, decoded with numpy across all blocks of a
batch at once, one nibble a step. The mu-law signal, resampled to 16 kHz by a half-band filter, is stored as a 16-bit PCM
WAVE file in a column of its own; its part of `feature` is computed from that file, read back.

Texts of any length are stored whole, each as one file.

NULL and empty texts give one padded block. Equal texts give equal bytes, digests and features. Repeated rows and NULL keys
pass through one by one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
BLOCK = 36
RATE = 8000
#: Payload bytes handled at once.
CHUNK = 1 << 19

# Fixed values of the IMA ADPCM format: steps and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230,
    253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327,
    3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exp, part = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exp == 0, part + 8, (part + 264) << np.maximum(exp - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU, A = mu_law_table(), a_law_table()


def _half_band(taps: int = 16) -> np.ndarray:
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t) * np.hanning(taps + 2)[1:-1]
    return (h / h.sum()).astype(np.float32)


HALF = _half_band()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and the unpadded length."""
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % UNIT if b else UNIT), len(b)


def wave_file(data: bytes, tag: int, rate: int, bits: int) -> bytes:
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) * 8 // bits) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def samples_of(wave: bytes) -> bytes:
    """The data chunk of a WAVE file."""
    if wave[:4] != b"RIFF" or wave[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at < len(wave):
        name, size = wave[at : at + 4], struct.unpack_from("<I", wave, at + 4)[0]
        if name == b"data":
            return wave[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, 36): a header of predictor, index and a spare byte, then 64 nibbles, low first. To samples (n, 65)."""
    value = data[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(data[:, 2].astype(np.int32), 88)
    nibbles = np.stack([data[:, 4:] & 15, data[:, 4:] >> 4], axis=2).reshape(len(data), -1)
    codes = np.ascontiguousarray(nibbles.T)
    out = np.empty((65, len(data)), np.int16)
    out[0] = value
    for k in range(64):
        c = codes[k].astype(np.int32)
        move = ((2 * (c & 7) + 1) * STEPS[index]) >> 3
        value = np.clip(np.where(c & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + CHANGES[c & 7], 0, 88)
        out[k + 1] = value
    return out.T


def resampled(pcm: np.ndarray) -> np.ndarray:
    """From 8 to 16 kHz: the samples themselves, and between each two what the half-band filter makes of the 16 around."""
    n = len(HALF) // 2
    x = np.concatenate([np.full(n - 1, pcm[0]), pcm, np.full(n, pcm[-1])]).astype(np.float32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip(np.rint(np.convolve(x, HALF, "valid")), -32768, 32767)
    return out


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, files, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["key", "n_bytes", "media"])

        kind = b.column(0).type
        for k, t in zip(b.column(0), b.column(1), strict=True):
            data, n = payload_of(t.as_py())
            keys.append(k.as_py()), sizes.append(n), files.append(wave_file(data, 7, RATE, 8))
            held += len(data)
            if held > CHUNK:
                yield done()
                keys, sizes, files, held = [], [], [], 0
        if keys:
            yield done()


def _loud(x: np.ndarray) -> int:
    return round(float(np.sqrt(np.square(x, dtype=np.float64).mean())))


def _expand():
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]

    def read(keys: pa.Array, sizes: pa.Array, media: pa.Array) -> pa.RecordBatch:
        files = [x.as_py() for x in media]
        data = [samples_of(f) for f in files]
        n_blocks = np.array([len(x) // BLOCK for x in data])
        power = np.square(decode_adpcm(np.frombuffer(b"".join(data), np.uint8).reshape(-1, BLOCK)), dtype=np.float32).sum(axis=1, dtype=np.float64)
        power = np.add.reduceat(power, np.cumsum(n_blocks) - n_blocks)
        features, sounds = [], []
        for x, n, e in zip(data, n_blocks, power, strict=True):
            code = np.frombuffer(x, np.uint8)
            heard = MU[code]
            sounds.append(wave_file(resampled(heard).tobytes(), 1, 2 * RATE, 16))
            sound = samples_of(sounds[-1])
            turns = int(np.count_nonzero((heard[1:] < 0) != (heard[:-1] < 0)))
            features.append(f"mu={_loud(heard)};turns={turns};a={_loud(A[code])};adpcm={round(float(np.sqrt(e / (65 * n))))};pcm16k={zlib.crc32(sound):08x}")
        columns = [
            keys, sizes, pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data]),
            pa.array([zlib.crc32(x[-32:]) for x in data], pa.int64()), pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array(features), pa.array(sounds, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = held = 0
            for i, x in enumerate(b.column(2)):
                held += x.as_buffer().size
                if held > CHUNK or i + 1 == b.num_rows:
                    part = b.slice(first, i + 1 - first)
                    yield read(*part.columns)
                    first, held = i + 1, 0

    return go


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and media, the mu-law file."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(_store, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def expand(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What reading the stored files gives, and pcm, the resampled file."""
    kind = stored.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary"
    return stored.select(key, "n_bytes", "media").mapInArrow(_expand(), schema).withColumnRenamed("key", key)

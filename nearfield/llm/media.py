"""Media columns: telephony audio kept as WAV files of companded or ADPCM samples, with resampled PCM beside it.

A payload is a byte string of samples at 8 kHz: G.711 mu-law or A-law codes, or IMA-ADPCM blocks of ``BLOCK_BYTES``.
``store`` wraps it losslessly into a WAV file of the codec's format (7, 6 or 17); ``load`` parses the file and gives the
very bytes back, and the samples that they stand for, resampled to 16 kHz by linear interpolation within the recording.
Expanding a companded sample is a look-up in a table computed from the G.711 formulas; ADPCM blocks are decoded with one
numpy step for all blocks of a chunk at each of a block's positions.

Nulls are empty payloads: they become one padded unit.  Texts of any length are kept whole; equal payloads give equal
files, PCM and features, so ties and repeated rows give repeated results; an empty table gives an empty result; other
columns are carried as they are, and those named like results are replaced.  A file that is cut off, has no samples or
another format is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, utf8_column

UNIT_BYTES = 576
PAD_BYTE = 255
RATE = 8000
BLOCK_BYTES = 36  # header of 4 bytes and 64 samples of 4 bits

# The step sizes of IMA ADPCM, and how a code moves the index into them.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mu_law_table() -> np.ndarray:
    """The 16-bit sample of each mu-law code."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """The 16-bit sample of each A-law code."""
    code = np.arange(256) ^ 0x55
    segment, step = (code >> 4) & 7, (code & 15) << 4
    size = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MU_LAW, A_LAW = mu_law_table(), a_law_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next index for each index and 4-bit code."""
    index, code = np.arange(len(STEPS))[:, None], np.arange(16)[None, :]
    step = STEPS[index]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    change = np.where(code & 8, -size, size).astype(np.int32)
    after = np.clip(index + INDEX_MOVES[code & 7], 0, len(STEPS) - 1).astype(np.uint8)
    return change.ravel(), (after.astype(np.int32) * 16).ravel()


ADPCM_CHANGE, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 1 + 2 * (bytes - 4)) samples of blocks: each has its first sample, its index (clipped), a zero, then low nibble first."""
    sample = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)
    sample = np.where(sample > 32767, sample - 65536, sample).astype(np.int32)
    row = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0] + 1, len(blocks)), np.int16)
    out[0] = sample
    for i, pair in enumerate(codes):
        for j, code in enumerate((pair & 15, pair >> 4)):
            row += code
            sample += ADPCM_CHANGE[row]
            np.clip(sample, -32768, 32767, out=sample)
            row = ADPCM_NEXT[row]
            out[2 * i + j + 1] = sample
    return out.T


def resample_double(pcm: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Twice the rate by linear interpolation; the last sample of each recording, which begin at ``starts``, is held."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    if len(pcm):
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        ends = np.concatenate((np.zeros(0, np.int64) if starts is None else starts[1:], [len(pcm)])) - 1
        out[2 * ends + 1] = pcm[ends]
    return out


#: The format number of a WAV file for each codec.
FORMATS = {"mu-law": 7, "a-law": 6, "ima-adpcm": 17}


def wav_header(n: int, codec: str = "mu-law") -> bytes:
    """Of a mono file with ``n`` bytes of samples (n is even here)."""
    if codec == "ima-adpcm":
        each = 2 * (BLOCK_BYTES - 4) + 1
        kind = struct.pack("<HHIIHHHH", FORMATS[codec], 1, RATE, RATE * BLOCK_BYTES // each, BLOCK_BYTES, 4, 2, each)
        samples = n // BLOCK_BYTES * each
    else:
        kind = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
        samples = n
    body = struct.pack("<4sI", b"fmt ", len(kind)) + kind + struct.pack("<4sII4sI", b"fact", 4, samples, b"data", n)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body) + n, b"WAVE") + body


def parse_wav(file: bytes) -> tuple[str, int, bytes]:
    """(codec, bytes of a block, samples) of a WAV file, found by walking its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, block = 12, "", 0
    while at + 8 <= len(file):
        name, n = struct.unpack_from("<4sI", file, at)
        if at + 8 + n > len(file):
            raise ValueError("cut off")
        if name == b"fmt ":
            if n < 16:
                raise ValueError("no format")
            kind, channels, _, _, block = struct.unpack_from("<HHIIH", file, at + 8)
            codec = {number: c for c, number in FORMATS.items()}.get(kind, "")
            if not codec or channels != 1 or (codec == "ima-adpcm" and block <= 4):
                raise ValueError(f"format {kind} with {channels} channels")
        if name == b"data":
            if not codec or n % (block if codec == "ima-adpcm" else 1):
                raise ValueError("samples without their format, or a part of a block")
            return codec, block, file[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def read_wav(file: bytes) -> bytes:
    """The bytes of a WAV file's samples."""
    return parse_wav(file)[2]


def decode(codec: str, block: int, samples: bytes) -> np.ndarray:
    """The 16-bit samples that a file's bytes stand for."""
    data = np.frombuffer(samples, np.uint8)
    if codec == "ima-adpcm":
        return decode_adpcm(data.reshape(-1, block)).ravel()
    return (MU_LAW if codec == "mu-law" else A_LAW)[data]


def payload_of(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD_BYTE]) * (max(1, -(-len(text) // UNIT_BYTES)) * UNIT_BYTES - len(text))


def store(df: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes", codec: str = "mu-law") -> DataFrame:
    """``df`` without its text, with the padded payload's WAV file and the unpadded size."""
    kept = [f for f in df.schema.fields if f.name not in (text, media, n_bytes)]
    schema = T.StructType([*kept, T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                data, offsets = utf8_column(part.column(text))
                whole = data.tobytes()
                files = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = payload_of(whole[a:b])
                    files.append(wav_header(len(payload), codec) + payload)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f in kept or f.name == text]).mapInArrow(run, schema)


def features(payloads: list[bytes]) -> list[str]:
    """Mean squares of the mu-law, A-law and resampled samples, zero crossings, mean square and peak of the ADPCM samples."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in payloads])[:-1])).astype(np.int64)
    sizes = np.array([len(p) for p in payloads], np.int64)
    mu, a = MU_LAW[data], A_LAW[data]
    power = [np.add.reduceat(np.square(x, dtype=np.int64), starts) // sizes for x in (mu, a)]
    cross = np.zeros(len(mu), np.int64)
    cross[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    cross[starts] = 0
    crossings = np.add.reduceat(cross, starts)
    double = resample_double(mu, starts)
    resampled = np.add.reduceat(np.square(double, dtype=np.int64), 2 * starts) // (2 * sizes)
    pcm = decode_adpcm(data.reshape(-1, BLOCK_BYTES))
    block_starts = starts // BLOCK_BYTES
    squares = np.add.reduceat(np.square(pcm, dtype=np.int64).sum(1), block_starts) // (sizes // BLOCK_BYTES * pcm.shape[1])
    peaks = np.maximum.reduceat(np.abs(pcm.astype(np.int32)).max(1), block_starts)
    return [f"mu={m};a={x};pcm16k={r};zc={z};adpcm={s};peak={p}" for m, x, r, z, s, p in zip(power[0].tolist(), power[1].tolist(), resampled.tolist(), crossings.tolist(), squares.tolist(), peaks.tolist(), strict=True)]


def load(df: DataFrame, media: str = "media", pcm: str = "pcm16k") -> DataFrame:
    """``df`` with the payload read back from each file, its feature, and its samples as 16 kHz 16-bit PCM.

    ``features`` reads units of ``UNIT_BYTES``; a file of another size has none.
    """
    added = [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField(pcm, T.BinaryType())]
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in batch.column(media)], np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(sizes):  # about 2 MB at once, a longer file alone
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + (2 << 20), "right")))
                part = batch.slice(at, to - at)
                found = [parse_wav(f) for f in part.column(media).to_pylist()]
                whole = [i for i, (_, _, s) in enumerate(found) if s and len(s) % UNIT_BYTES == 0]
                feature: list[str | None] = [None] * len(found)
                for i, text in zip(whole, features([found[i][2] for i in whole]) if whole else [], strict=True):
                    feature[i] = text
                decoded = [decode(*f) for f in found]
                starts = np.concatenate(([0], np.cumsum([len(d) for d in decoded]))).astype(np.int64)
                real = starts[:-1][np.diff(starts) > 0]
                double = resample_double(np.concatenate(decoded), real).tobytes()
                pcms = [double[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                columns = [pa.array([s for _, _, s in found], pa.binary()), pa.array(feature, pa.string()), pa.array(pcms, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *columns], names=schema.names)
                at = to

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)

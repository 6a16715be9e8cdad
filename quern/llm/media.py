"""Media columns: texts stored as WAV, read back, and fingerprinted by spectral peaks.

``to_media`` packs the UTF-8 bytes of a text, padded with zero bytes to a positive
multiple of 64, as 8-bit samples of a mono WAV. ``read_media`` opens the stored bytes with
the wave module and derives digests and the fingerprint: magnitudes of a short-time
Fourier transform, the strongest bin of each band and frame where it stands out, and
pairs of such peaks near in time as ``time << 24 | f1 << 15 | f2 << 6 | dt``, an array
ordered by time.

Edge cases: a null text is empty and has 64 zero bytes; silence has no peaks and so an
empty fingerprint; ties of bins go to the lower one; equal texts, and so repeated rows, have
equal values; a null id stays null; long texts are transformed in blocks of frames, so memory
does not grow with the spectrum; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, HOP, RATE = 1024, 512, 8000
#: Bands of bins in which the strongest is a candidate; each about twice as wide as the last.
BANDS = (4, 16, 32, 64, 128, 256, 512)
#: A candidate is a peak if it exceeds the mean of its frame's candidates this many times.
STANDS_OUT = 1.0
FAN, REACH = 3, 63
_BLOCK = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)

MEDIA = "doc_id {id}, n_bytes long, media binary"
READ = (
    "doc_id {id}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, fingerprint array<long>, feature string"
)


def wav_of(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def payload_of(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks, in order of time and then frequency."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for at in range(0, n, _BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + _BLOCK] * _WINDOW, axis=1))[:, :512]
        best = np.stack([power[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:])], 1)
        height = np.take_along_axis(power, best, 1)
        keep = height > STANDS_OUT * height.mean(1, keepdims=True)
        t, k = np.nonzero(keep)
        times.append(t + at)
        bins.append(best[t, k])
    return np.concatenate(times).astype(np.int64), np.concatenate(bins).astype(np.int64)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks: each peak with the next ``FAN``, at most ``REACH`` frames on."""
    t, f = peaks(samples)
    codes = []
    for j in range(1, FAN + 1):
        dt = t[j:] - t[:-j]
        near = dt <= REACH
        codes.append((t[:-j] << 24 | f[:-j] << 15 | f[j:] << 6 | dt)[near])
    return np.sort(np.concatenate(codes))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the WAV of every text."""

    def store(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([wav_of(padded(x)) for x in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select("doc_id", "text").mapInArrow(store, MEDIA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def read_media(media: DataFrame) -> DataFrame:
    """Digests and fingerprint of what the stored bytes hold."""

    def read(batches):
        for batch in batches:
            stored = batch.column(2).to_pylist()
            rows = []
            for wav in stored:
                payload = payload_of(wav)
                code = fingerprint(np.frombuffer(payload, np.uint8))
                feature = f"{len(code)}:{hashlib.sha256(code.astype('<i8').tobytes()).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), code, feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprint", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, READ.format(id=media.schema["doc_id"].dataType.simpleString()))


def media_features(docs: DataFrame) -> DataFrame:
    return read_media(to_media(docs)).select(
        F.col("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint", F.size("fingerprint").alias("n_pairs")
    )

"""Texts stored as WAV sound and fingerprinted by pairs of spectral peaks (operator 4).

The payload of a document is its text in UTF-8, filled with zero bytes up to a positive
multiple of 64. It becomes the samples of a mono 8-bit WAV file (``wave`` module), is read
back from the stored bytes, and short-time Fourier transforms of all of it give the peaks:
the strongest bin of each frequency band where it tops the frames before and after. Each
peak is paired with the next ``FAN`` peaks of later frames; a pair is one 64-bit integer, time
in the high half, the two bins and the distance in time in the low half, and a document's
pairs are an array in time order. Frames overlap by half, so every sample counts. A map over documents: nothing is shuffled, long texts are transformed
in blocks of frames.

Defined results: a null text counts as the empty text (64 zero bytes, no fingerprint pairs
beyond those of silence, which has no peaks); distances of 65535 frames and more count as
65535; a null doc_id is carried along; equal texts give equal values, repeated rows
repeated ones; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

RATE, FRAME, HOP, FAN = 8000, 256, 128, 3
#: Frequency bins of a frame, in bands of about an octave.
BANDS = ((1, 9), (9, 17), (17, 33), (33, 65), (65, 129))
BLOCK = 4096

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, fingerprint array<long>"
)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its power for each frame and band: two arrays (frames, bands)."""
    wave_ = np.frombuffer(samples, dtype=np.uint8)
    frames = max(1, -(-max(0, len(wave_) - FRAME) // HOP) + 1)
    bins, power = np.empty((frames, len(BANDS)), np.int64), np.empty((frames, len(BANDS)), np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, frames, BLOCK):
        n = min(BLOCK, frames - at)
        part = wave_[at * HOP : (at + n - 1) * HOP + FRAME].astype(np.float32) - 128
        part = np.pad(part, (0, (n - 1) * HOP + FRAME - len(part)))
        rows = np.lib.stride_tricks.as_strided(part, (n, FRAME), (part.strides[0] * HOP, part.strides[0]))
        spectrum = np.fft.rfft((rows - rows.mean(axis=1, keepdims=True)) * window, axis=1)
        energy = spectrum.real**2 + spectrum.imag**2
        for b, (lo, hi) in enumerate(BANDS):
            top = energy[:, lo:hi].argmax(axis=1)
            bins[at : at + n, b] = top + lo
            power[at : at + n, b] = energy[np.arange(n), top + lo]
    return bins, power


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs: time << 32 | first bin << 24 | second bin << 16 | frames between."""
    bins, power = band_peaks(samples)
    edge = np.full((1, power.shape[1]), -1, np.float32)
    peak = (power > np.concatenate([edge, power[:-1]])) & (power >= np.concatenate([power[1:], edge])) & (power > 1e-3)
    t, b = np.nonzero(peak)
    f = bins[t, b]
    later = np.searchsorted(t, t, side="right")[:, None] + np.arange(FAN)
    first, second = np.broadcast_to(np.arange(len(t))[:, None], later.shape)[later < len(t)], later[later < len(t)]
    out = (t[first] << 32) | (f[first] << 24) | (f[second] << 16) | np.minimum(t[second] - t[first], 65535)
    out.sort()
    return out


def _features(keep_media: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1)
            for at in range(0, len(ids), 256):
                rows: list[tuple] = []
                for text in texts.slice(at, 256).to_pylist():
                    samples, n = payload(text)
                    media = to_wav(samples)
                    back = from_wav(media)
                    pairs = fingerprint(back)
                    feature = f"{len(pairs)}:{hashlib.sha256(pairs.astype('<i8').tobytes()).hexdigest()}"
                    row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, pairs)
                    rows.append(row + (media,) * keep_media)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())] + [pa.binary()] * keep_media
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"] + ["media"] * keep_media
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *columns], names=names)

    return run


def wav_features(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Digests, fingerprint and, if wanted, the WAV bytes (``media``) of each document."""
    return mapped(docs.select("doc_id", "text"), _features(keep_media), SCHEMA + ", media binary" * keep_media)


def op4_wav_peaks(spark, sf_dir: str) -> DataFrame:
    return wav_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))

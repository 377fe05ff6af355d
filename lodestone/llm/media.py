"""Media columns: bytes held as WAV, and fingerprints of pairs of spectral peaks.

A payload is the UTF-8 bytes of a text, followed by bytes 255 up to a positive multiple of FRAME. It is
stored as mono 8-bit samples of a WAV file, one byte a sample, and all features come from the stored
file read back. Each row is taken by itself: no shuffle; a null text is the empty text; equal texts have
equal results, since every transform is computed for one text alone, in pieces of a fixed size. A text of any
length is one file, which must fit in a task's memory; an empty table has no rows, repeated rows repeat theirs. Of
equal magnitudes in a band the lowest frequency is the peak. Input columns with the names of results are replaced;
others cannot clash.
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

from lodestone.llm.common import by_rows, named, others

FRAME, HOP, RATE = 576, 288, 8000
#: Frames transformed at once; the work space of a long text stays bounded.
BLOCK = 512
#: A frame's peaks: the largest of each of these bands of bins, if it exceeds its neighbours in time.
BANDS = (1, 9, 18, 36, 72, 144, 289)
#: Frames ahead in which a peak finds partners, and how many partners it takes.
REACH, PARTNERS = 8, 3
ROWS = 128


def payload(text: str | None) -> bytes:
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % FRAME if b else FRAME)


def store(data: bytes) -> bytes:
    """A WAV file whose samples are the bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform, a block of frames at a time."""
    x = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(x), BLOCK):
        yield np.abs(np.fft.rfft((x[at : at + BLOCK].astype(np.float64) - 128.0) * _window, axis=1))


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Codes time << 32 | bin << 20 | partner's bin << 8 | frames between, in order of time."""
    found: list[np.ndarray] = []
    strong: list[np.ndarray] = []
    for mag in spectra(samples):
        found.append(np.stack([mag[:, a:b].argmax(axis=1) + a for a, b in zip(BANDS, BANDS[1:], strict=False)], axis=1))
        strong.append(np.take_along_axis(mag, found[-1], axis=1))
    bins, power = np.concatenate(found), np.concatenate(strong)
    edge = np.zeros((1, power.shape[1]))
    # strictly above the frame before, not below the next: of equal neighbours the first is the peak
    peak = (power > np.concatenate([edge, power[:-1]])) & (power >= np.concatenate([power[1:], edge]))
    t, band = np.nonzero(peak)
    f = bins[t, band].astype(np.int64)
    out = []
    for k in range(1, PARTNERS + 1):  # the next peaks in order of time and frequency
        if len(t) > k:
            gap = t[k:] - t[:-k]
            ok = gap <= REACH
            out.append((t[:-k][ok].astype(np.int64) << 32) | (f[:-k][ok] << 20) | (f[k:][ok] << 8) | gap[ok])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, keep: list[str] | None = None, text: str = "text", with_media: bool = True) -> DataFrame:
    """Columns ``keep``, then n_bytes (unpadded), payload_bytes, payload_sha256, tail_crc32 (of the last 32
    bytes), media_bytes, media_sha256, feature string (frames, pairs and a digest of the codes),
    fingerprints array<bigint> and, if asked for, media binary."""
    out = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, fingerprints array<bigint>"
    out += ", media binary" if with_media else ""

    def one(text: str | None) -> tuple:
        media = store(payload(text))
        back = load(media)
        codes = fingerprints(np.frombuffer(back, np.uint8))
        frames = 1 + (len(back) - FRAME) // HOP
        feature = f"stft{FRAME}/{HOP}:{frames}:{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}"
        got = (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes)
        return (*got, media) if with_media else got

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def run(col: pa.Array) -> list[pa.Array]:
        return [pa.array(values, t) for values, t in zip(zip(*map(one, col.to_pylist()), strict=True), types, strict=False)]

    return by_rows(docs, others(docs, out) if keep is None else keep, [named(text)], out, lambda: run, ROWS)

"""Media columns: bytes as 8-bit WAV, read back by the wave module, and spectral-peak fingerprints.

The payload is the text's UTF-8 bytes with bytes 255 up to a positive multiple of 576.  It is stored as mono samples of one byte, read back, and cut
into frames of 576 samples every 288.  Each frame's windowed Fourier transform gives up to three spectral peaks; a peak and each peak of the
next four frames, up to three of them, form a pair.  A fingerprint is time << 32 | bin << 20 | later bin << 8 | distance, so a row's array is sorted by time.

Rows: a null text counts as empty: one padded block, which has no peak.  Equal texts give equal values.  Long texts are transformed in blocks of frames, so
memory stays bounded by the text itself.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.shared import keyed_text

BLOCK, HOP, PEAKS, REACH, FANOUT, RATE = 576, 288, 3, 4, 3, 8000
FRAMES_AT_ONCE = 2048
_WINDOW = np.hanning(BLOCK)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def _peaks(frames: np.ndarray) -> np.ndarray:
    """Bins of the largest local maxima of each frame, strongest first; 0 where there are fewer."""
    size = np.abs(np.fft.rfft(frames * _WINDOW, axis=1))
    inner = size[:, 3:-1]
    top = np.where((inner > size[:, 2:-2]) & (inner >= size[:, 4:]) & (inner > 1e-3), np.round(inner, 3), 0.0)
    order = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
    return np.where(np.take_along_axis(top, order, 1) > 0, order + 3, 0)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """The peak pairs of one row's samples."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, BLOCK)[::HOP]
    peaks = np.concatenate([_peaks(frames[k : k + FRAMES_AT_ONCE].astype(np.float64) - 128) for k in range(0, len(frames), FRAMES_AT_ONCE)])
    n = len(peaks)
    later = np.zeros((n, REACH * PEAKS), np.int64)
    for d in range(1, REACH + 1):
        later[: max(n - d, 0), (d - 1) * PEAKS : d * PEAKS] = peaks[d:]
    # the first FANOUT of them
    good = later > 0
    good &= np.cumsum(good, axis=1) <= FANOUT
    t, column = np.nonzero(good)
    near, far, distance = peaks[t], later[t, column], column // PEAKS + 1
    pairs = t[:, None] << 32 | near << 20 | (far << 8 | distance)[:, None]
    return np.unique(pairs[near > 0])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, fingerprints[, media]: one row for each row of docs."""

    def run(batches):
        for batch in batches:
            rows, prints, medias = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                media = to_wav(padded(text))
                payload = from_wav(media)
                rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
                prints.append(fingerprints(np.frombuffer(payload, np.uint8)))
                if keep_media:
                    medias.append(media)
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in prints])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*prints, np.zeros(0, np.int64)])))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints"]
            more = [pa.array(medias, pa.binary())] if keep_media else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), lists, *more], names + ["media"] * keep_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>"
    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema + ", media binary" * keep_media)

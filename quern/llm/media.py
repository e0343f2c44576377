"""Media columns: texts' bytes as WAV sound, and fingerprints of its spectral peaks.

A payload is stored as 8-bit mono samples in a WAV file, read back by the wave
module, and cut into half-overlapping frames. Each frame's short-time Fourier
transform gives the strongest bin of a few bands; one that also beats its band's
bins in the frames before and after it is a peak. A peak and each of the next
few make a pair, coded as (bin, bin, distance) and stored at the first one's time.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import extend, shipped

shipped(__name__)

#: Bytes of a frame: a payload is a positive multiple of it, filled up with FILL.
FRAME, FILL, RATE = 576, b"\xff", 8000
HOP = FRAME // 2
#: First bins of the bands, and the end of the last.
BANDS = (2, 18, 48, 110, HOP + 1)
#: Pairs of a peak, and how many hops apart they may be.
FAN, REACH = 3, 15
#: Frames that are transformed at a time: bounds memory for texts of any length.
AT_ONCE = 2048


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + FILL * (-len(data) % FRAME if data else FRAME)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its magnitude (in whole sixteenths) for each frame and band."""
    n = (len(samples) - FRAME) // HOP + 1
    window = np.hanning(FRAME).astype(np.float32)
    bins, sizes = np.empty((n, len(BANDS) - 1), np.int32), np.empty((n, len(BANDS) - 1), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for i in range(0, n, AT_ONCE):
        part = (frames[i : i + AT_ONCE].astype(np.float32) - np.float32(128)) * window
        spectrum = (np.abs(np.fft.rfft(part, axis=1)) * 16).astype(np.int64)
        for b, (lo, hi) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            best = spectrum[:, lo:hi].argmax(axis=1)
            bins[i : i + len(part), b] = best + lo
            sizes[i : i + len(part), b] = np.take_along_axis(spectrum[:, lo:hi], best[:, None], 1)[:, 0]
    return bins, sizes


def fingerprint(bins: np.ndarray, sizes: np.ndarray, frame: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, time (in hops), code of every pair, for frames of many documents in a row."""
    same = np.r_[False, doc[1:] == doc[:-1]]
    before = np.where(same[:, None], np.r_[sizes[:1], sizes[:-1]], -1)
    after = np.where(np.r_[same[1:], False][:, None], np.r_[sizes[1:], sizes[-1:]], -1)
    row, band = np.nonzero((sizes > before) & (sizes >= after) & (sizes > 0))
    f, t, d = bins[row, band], frame[row], doc[row]
    found = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        ok = np.nonzero((d[k:] == d[:-k]) & (gap <= REACH))[0]
        found.append((ok, f[ok].astype(np.int64) << 20 | f[ok + k] << 8 | gap[ok]))
    at, code = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((code, at))
    at = at[order]
    return d[at], t[at], code[order]


def listener(media_list: list[bytes]):
    payloads = [from_wav(m) for m in media_list]
    parts = [band_peaks(np.frombuffer(p, np.uint8)) for p in payloads]
    counts = [len(b) for b, _ in parts]
    doc = np.repeat(np.arange(len(parts)), counts)
    frame = np.concatenate([np.arange(c) for c in counts])
    d, t, code = fingerprint(np.concatenate([b for b, _ in parts]), np.concatenate([s for _, s in parts]), frame, doc)
    offsets = pa.array(np.searchsorted(d, np.arange(len(parts) + 1)).astype(np.int32))
    return payloads, pa.ListArray.from_arrays(offsets, pa.array(t.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(code.astype(np.int32)))


def transcoder():
    """From texts to the stored form and to what is read back from it."""

    def compute(texts: list[str]) -> list:
        media = [to_wav(payload_of(t)) for t in texts]
        payloads, times, codes = listener(media)
        return [pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), times, codes]

    return compute


def as_sound(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with media (the WAV file), payload (read back from it), times and codes (arrays of int, pair by pair).

    A null or empty text is one frame of fill bytes. Equal texts give equal
    columns. Columns of these names are replaced; no rows give no rows.
    """
    return extend(documents, text, {"media": T.BinaryType(), "payload": T.BinaryType(), "times": T.ArrayType(T.IntegerType(), False), "codes": T.ArrayType(T.IntegerType(), False)}, transcoder)


def feature():
    """Column: the time-coded array as text, ``code@time`` by time."""
    return F.array_join(F.zip_with("codes", "times", lambda c, t: F.concat(F.lower(F.hex(c)), F.lit("@"), t)), ",")

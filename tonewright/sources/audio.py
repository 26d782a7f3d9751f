"""Decoding PCM WAV and computing per-channel energy normalised mel clips with NumPy only."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tonewright.functions.geometry import HIGH_HZ, LOW_HZ

# fixed values: settings under which models were trained
RATE, N_FFT, HOP, MELS, FRAMES = 32000, 2048, 375, 256, 252
GAIN, BIAS, POWER, TIME_CONSTANT = 0.75, 1.0, 0.35, 1.0
LEFT_PAD = 16000  # half a second that is heard twice
SCALE = 2.0**31
SEGMENT_S, PAD_S, HOP_S, CLIP_S = 60, 2, 1.5, 3.0


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples between -1 and 1 and their rate."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(2 ** (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1), rate


def _filters() -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale, of equal area."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(LOW_HZ), mel(HIGH_HZ), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / RATE)
    up = (f[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - f[None]) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def _window() -> np.ndarray:
    # fixed values: coefficients of the flat-top window
    a = (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368)
    n = 2 * np.pi * np.arange(N_FFT) / N_FFT
    return sum((-1) ** k * c * np.cos(k * n) for k, c in enumerate(a))


def normalised(energy: np.ndarray) -> np.ndarray:
    """Per-channel energy normalisation of mel energies, channels by frames; the smoother starts at 1."""
    t = TIME_CONSTANT * RATE / HOP
    s = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    level, smooth = np.ones(len(energy)), np.empty_like(energy)
    for k in range(energy.shape[1]):
        level = (1 - s) * level + s * energy[:, k]
        smooth[:, k] = level
    return BIAS**POWER * np.expm1(POWER * np.log1p(energy * np.exp(-GAIN * (np.log(1e-6) + np.log1p(smooth / 1e-6))) / BIAS))


def pcen(samples: np.ndarray) -> np.ndarray:
    """Normalised mel energies, MELS by frames, of samples between -1 and 1 at RATE.

    The first half second is heard twice, and the smoother first runs over up to 100 frames
    from the start, a quarter of all at most; both are cut off again.
    """
    x = np.concatenate([samples[:LEFT_PAD], samples]).astype(np.float64) * SCALE
    if len(x) < N_FFT:
        return np.empty((MELS, 0), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP]
    energy = _filters() @ (np.abs(np.fft.rfft(frames * _window(), axis=1)) ** 2).T
    warm = min(100, energy.shape[1] // 4)
    out = normalised(np.concatenate([energy[:, :warm], energy], axis=1))
    return out[:, warm + min(len(samples), LEFT_PAD) // HOP :].astype(np.float32)


def clips_of_samples(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Number and spectrum, MELS by FRAMES, of every clip of samples at RATE.

    Clips of 3 s start every 1.5 s and lie whole in the recording. Spectra are computed for
    one minute at a time with 2 s around it; a clip belongs to the minute in which it starts.
    A rest shorter than two transforms, or a clip whose frames don't reach, gives none.
    """
    n = int((len(x) / RATE - CLIP_S) // HOP_S) + 1 if len(x) >= CLIP_S * RATE else 0
    size = SEGMENT_S * RATE
    for first in range(0, len(x), size):
        lo, hi = max(0, first - PAD_S * RATE), min(len(x), first + size + PAD_S * RATE)
        if hi - lo < 2 * N_FFT:
            break
        own = [k for k in range(int(first / RATE // HOP_S), n) if first <= k * HOP_S * RATE < first + size]
        spec = pcen(x[lo:hi]) if own else None
        for k in own:
            a = int((k * HOP_S - lo / RATE) * RATE / HOP)
            if a + FRAMES <= spec.shape[1]:
                yield k, spec[:, a : a + FRAMES]


def clips_of(files: DataFrame, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav) -> DataFrame:
    """Clips of audio files (``path, content``) with their normalised spectra, one minute at a time.

    ``decode`` turns a file's bytes into mono samples between -1 and 1 and their rate; the
    built-in one reads PCM WAV, give another for flac, ogg or mp3. A file that can't be
    decoded gives one row with ``error`` set instead of failing the job.
    """
    schema = "path string, clip_no bigint, clip_start double, clip_end double, pcen array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    x, rate = decode(content)
                    if rate != RATE:
                        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x).astype(np.float32)
                except Exception as e:  # noqa: BLE001 - any broken file is reported, none stops the others
                    yield pd.DataFrame([(path, None, None, None, None, str(e)[:200])], columns=columns)
                    continue
                rows = []
                for k, part in clips_of_samples(x):
                    rows.append((path, k, k * HOP_S, k * HOP_S + CLIP_S, part.ravel(), None))
                    if len(rows) == 40:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)

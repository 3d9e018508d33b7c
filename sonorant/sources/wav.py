"""WAV audio (mono or not, 16-bit PCM) as tables: headers, frames and pieces cut at quiet points."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_MS, RATE = 100, 16_000


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples and their rate."""
    with wave.open(io.BytesIO(content)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
        return x.reshape(-1, w.getnchannels()).mean(1), w.getframerate()


def encode(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(samples), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    n = round(len(samples) / rate * to)
    return samples if rate == to or not n else np.interp(np.linspace(0, len(samples) - 1, n), np.arange(len(samples)), samples)


def quiet_cuts(x: np.ndarray, rate: int, seconds: float, last: float = 1 / 3) -> list[int]:
    """Where to cut samples into pieces of at most `seconds`: a table of how loud each 100 ms is, and of each piece's last third
    the quietest of them, in its middle."""
    step, most = rate // 10, int(seconds * rate)
    loud = np.abs(x[: len(x) // step * step]).reshape(-1, step).mean(1)
    cuts = [0]
    while len(x) - cuts[-1] > most:
        table = slice(-int(-(cuts[-1] + (1 - last) * most) // step), (cuts[-1] + most) // step)
        cuts.append((table.start + int(loud[table].argmin())) * step + step // 2)
    return [*cuts, len(x)]


def pieces(content: bytes, seconds: float) -> list[bytes]:
    """Pieces of at most `seconds`, cut where it is quiet."""
    x, rate = decode(content)
    cuts = quiet_cuts(x, rate, seconds)
    return [encode(x[a:b], rate) for a, b in zip(cuts, cuts[1:], strict=False)]


def read(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """clip_id (file stem), duration_seconds, source_rate, upsampled, wav (mono, at `rate`), error."""

    def run(batches):
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                stem = p.rsplit("/", 1)[-1].rsplit(".", 1)[0].strip()
                try:
                    x, own = decode(c)
                    if not len(x):
                        raise ValueError("no samples")
                    rows.append((stem, len(x) / own, own, own < rate, encode(resample(x, own, rate), rate), None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((stem, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["clip_id", "duration_seconds", "source_rate", "upsampled", "wav", "error"]).astype({"source_rate": "Int64", "upsampled": "boolean"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "clip_id string, duration_seconds double, source_rate long, upsampled boolean, wav binary, error string")


def frames(clips: DataFrame, ms: int = FRAME_MS) -> DataFrame:
    """clips (clip_id, wav) -> clip_id, frame, audio_start, audio_end, pcm: frames of `ms`, the last one shorter."""

    def run(batches):
        for b in batches:
            rows = []
            for clip, content in zip(b["clip_id"], b["wav"], strict=True):
                x, rate = decode(content)
                n = max(1, int(rate * ms / 1000))
                pcm = x.astype("<i2")
                rows += [(clip, k, s / rate, min(s + n, len(x)) / rate, pcm[s : s + n].tobytes()) for k, s in enumerate(range(0, len(x), n))]
            yield pd.DataFrame(rows, columns=["clip_id", "frame", "audio_start", "audio_end", "pcm"])

    return clips.where(F.col("wav").isNotNull()).select("clip_id", "wav").mapInPandas(run, "clip_id string, frame int, audio_start double, audio_end double, pcm binary")

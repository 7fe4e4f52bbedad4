"""Audio columns: WAV storage, polyphase resampling, log-mel filterbanks, hysteresis segmentation.

A payload of bytes is stored losslessly as 8-bit mono PCM in a WAV container and read back from it.
Features come from the read-back samples: a windowed-sinc polyphase filter changes the rate by
UP / DOWN; overlapped Hann frames give log-mel bands, cut into fixed-shape float32 tensors with
their time spans, as an Arrow stream with the fixed-shape tensor type; frame energy is segmented
with two thresholds (a segment opens above the high one and closes below the low one).

Each document is computed on its own, so equal payloads give equal values. Edge cases: null and
empty texts are a payload of 192 blanks; constant samples have no segment; very long texts are
filtered and framed piece by piece; repeated rows have equal values; an empty table gives an empty
result; columns other than doc_id and the text's aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.text import column_bytes, pieces

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 12
FRAME, HOP, MELS = 256, 128, 40
#: Frames of a tensor.
CLIP = 64
PAD, UNIT = 32, 192
#: Samples that are filtered at once.
SPAN = 1 << 20


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; one byte is one sample."""
    n = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _filter(up: int, down: int) -> np.ndarray:
    """A row of taps for each phase of the interpolating low-pass filter."""
    wide = max(up, down)
    t = np.arange(-TAPS * wide, TAPS * wide + 1)
    h = np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1]
    h *= up / h.sum()
    per = -(-len(h) // up)
    return np.pad(h, (0, per * up - len(h))).reshape(per, up).T.astype(np.float32)


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output n uses the taps of phase n * down mod up only."""
    phases = _filter(up, down)
    per = phases.shape[1]
    half = TAPS * max(up, down)
    n = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(per, np.float32), samples, np.zeros(per + half // up + 1, np.float32)])
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, per)
    for first in range(up):
        at = (np.arange(first, n, up) * down + half) // up
        phase = (first * down + half) % up
        taps = phases[phase][::-1].copy()
        for a in range(0, len(at), SPAN):
            part = at[a : a + SPAN]
            step = down
            view = windows[part[0] + 1 : part[-1] + 2 : step]
            out[first::up][a : a + SPAN] = view @ taps
    return out


@lru_cache(maxsize=4)
def _mel(rate: float, bands: int = MELS, n_fft: int = FRAME) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale from 0 to half the rate."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(samples: np.ndarray, rate: float) -> np.ndarray:
    """frames x MELS; the end is padded with zeros, so that every sample is in a frame."""
    short = FRAME - len(samples) if len(samples) < FRAME else -(len(samples) - FRAME) % HOP
    samples = np.pad(samples, (0, short))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    mel = _mel(rate)
    out = np.empty((len(frames), MELS), np.float32)
    for a in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[a : a + 4096] * _WINDOW)) ** 2
        out[a : a + 4096] = np.log(power.astype(np.float32) @ mel + np.float32(1e-6))
    return out


def segments(energy: np.ndarray) -> np.ndarray:
    """Start and end frame of each stretch that rises above mean + sd / 2, until it falls below the mean."""
    mean, sd = float(energy.mean()), float(energy.std())
    if sd < 1e-6:
        return np.zeros((0, 2), np.int64)
    mark = np.where(energy > mean + sd / 2, 1, np.where(energy < mean, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def tensors(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of (start, end, tensor): fixed-shape tensors of CLIP x MELS; the last is padded with its lowest value."""
    n = -(-len(mel) // CLIP)
    full = np.full((n * CLIP, MELS), mel.min(), np.float32)
    full[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [CLIP, MELS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CLIP * MELS)
    start = np.arange(n) * CLIP * HOP / rate
    end = np.minimum((np.arange(n) + 1) * CLIP, len(mel)) * HOP / rate
    batch = pa.record_batch([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(kind, flat)], names=["start", "end", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def analyse(media: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel frames, segments (in frames) and the rate of the frames' samples."""
    payload, rate = from_wav(media)
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    rate = rate * UP / DOWN
    mel = log_mel(resample(samples), rate)
    return mel, segments(mel.mean(1)), rate


def media_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Adds n_bytes, media (WAV), tensors (Arrow stream) and spans (seconds of each segment)."""
    for batch in pieces(batches, column):
        buf, at = column_bytes(batch.column(batch.schema.get_field_index(column)))
        raw = buf.tobytes()
        media, streams, spans = [], [], []
        for a, b in zip(at.tolist(), at[1:].tolist()):
            text = raw[a:b]
            wav = to_wav(text + bytes([PAD]) * (-len(text) % UNIT if text else UNIT))
            mel, found, rate = analyse(wav)
            media.append(wav)
            streams.append(tensors(mel, rate))
            spans.append([{"start": float(x) * HOP / rate, "end": float(y) * HOP / rate} for x, y in found])
        kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(at), pa.int64()), pa.array(media, pa.binary()), pa.array(streams, pa.binary()), pa.array(spans, kind)],
            names=[*batch.schema.names, "n_bytes", "media", "tensors", "spans"],
        )


def with_audio(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, tensors and spans of each text's bytes."""
    texts = docs.select("doc_id", F.coalesce(column, F.lit("")).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in media_batches(it, "text"):
            yield b.select(["doc_id", "n_bytes", "media", "tensors", "spans"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, media binary, tensors binary, spans array<struct<start: double, end: double>>")


def digests(docs: DataFrame, column: str = "text") -> DataFrame:
    """Per document: sizes and checksums of the payload read back and of the stored form, and a summary of the features."""
    texts = docs.select("doc_id", F.coalesce(column, F.lit("")).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in media_batches(it, "text"):
            rows: list[tuple] = []
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n_bytes", "media", "tensors", "spans"))
            for n, media, stream, spans in zip(*columns):
                payload, _ = from_wav(media)
                clips = pa.ipc.open_stream(stream).read_all()
                mel = clips.column("tensor").combine_chunks().storage.flatten().to_numpy()
                seconds = sum(s["end"] - s["start"] for s in spans)
                feature = f"clips={clips.num_rows} mel={float(mel.mean()):.2f} top={float(mel.max()):.2f} segments={len(spans)} seconds={seconds:.3f}"
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(zip(*rows), kinds)]], names=["doc_id", *names])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: audio stored as WAV, and features of it as fixed-shape Arrow tensors.

Samples are 8-bit mono PCM at 12 kHz.  Features: a polyphase resampler (up 2, down 3) to
8 kHz, overlapped frames of 200 samples every 80, log-mel filterbank energies, and segments
from a hysteresis over the frame energies (a run above the lower threshold that reaches the
upper one).  Frames are stored in tensors of shape (32, 24), the last one filled up with the
floor, each with its time span, as an Arrow IPC stream in a binary column.

Each signal is computed on its own and in steps of fixed size, so equal signals give equal
features whatever batch they are in.

Defined results: a null text is an empty one, which is 192 blanks; a signal shorter than a
frame is filled up with zeros; media that is null or isn't such a WAV gives null features;
repeated rows are independent; other columns, whatever their names, aren't looked at; an
empty table gives no rows.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import discard, materialise, text_bytes

RATE, OUT_RATE, UP, DOWN, TAPS = 12_000, 8_000, 2, 3, 16
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
#: frames of one tensor, and frames computed together
SHAPE, STEP = (32, MELS), 2048
FLOOR = 1e-10
UNIT = 192
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    return _HEAD.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes | None) -> bytes | None:
    """Samples of an 8-bit mono PCM file; None if it is none."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, known = 12, False
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            known = size >= 16 and struct.unpack_from("<HH", media, at + 8) == (1, 1) and struct.unpack_from("<H", media, at + 22) == (8,)
        elif name == b"data":
            return media[at + 8 : at + 8 + size] if known and at + 8 + size <= len(media) else None
        at += 8 + size + size % 2
    return None


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Taps of the resampler by phase, the frames' window, and the mel filters."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    low = np.sinc(n / DOWN) / DOWN * np.hamming(TAPS * UP) * UP
    phases = np.stack([low[p::UP][::-1] for p in range(UP)]).astype(np.float32)
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FFT, 1 / OUT_RATE)[:, None]
    rise, fall = (freq - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - freq) / np.diff(edges)[1:]
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def resample(signal: np.ndarray) -> np.ndarray:
    """``signal`` at OUT_RATE: each output sample is one phase of the low-pass over TAPS inputs."""
    phases = tables()[0]
    n = -(-len(signal) * UP // DOWN)
    out = np.zeros(n + n % UP, np.float32)
    wide = np.concatenate([np.zeros(TAPS // 2, np.float32), signal, np.zeros(TAPS + DOWN * UP, np.float32)])
    for first in range(0, len(out), UP * STEP * 8):
        count = min(STEP * 8, (len(out) - first) // UP)
        part = wide[first // UP * DOWN :][: count * DOWN + TAPS + DOWN]
        views = np.lib.stride_tricks.sliding_window_view(part, TAPS)
        for p in range(UP):
            out[first + p : first + p + count * UP : UP] = views[p * DOWN // UP :: DOWN][:count] @ phases[p * DOWN % UP]
    return out[:n]


def log_mel(signal: np.ndarray) -> np.ndarray:
    _, window, filters = tables()
    if len(signal) < FRAME:
        signal = np.append(signal, np.zeros(FRAME - len(signal), np.float32))
    views = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    out = np.empty((len(views), MELS), np.float32)
    for k in range(0, len(views), STEP):
        part = np.fft.rfft(views[k : k + STEP] * window, FFT)
        out[k : k + STEP] = np.log10(np.maximum((part.real**2 + part.imag**2).astype(np.float32) @ filters, FLOOR))
    return out


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans of the runs above the mean energy that rise over it by half a deviation."""
    low = energy.mean()
    high = low + 0.5 * energy.std()
    above = np.concatenate([[False], energy >= low, [False]])
    edge = np.flatnonzero(above[1:] != above[:-1])
    loud = np.append(0, np.cumsum(energy >= high))
    return [(a * HOP / OUT_RATE, ((b - 1) * HOP + FRAME) / OUT_RATE) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if loud[b] > loud[a]]


def tensors(frames: np.ndarray) -> bytes:
    """Arrow IPC stream of (frames: fixed-shape tensor, start, end), in seconds."""
    n = -(-len(frames) // SHAPE[0])
    whole = np.full((n * SHAPE[0], MELS), np.log10(FLOOR), np.float16)
    whole[: len(frames)] = frames
    kind = pa.fixed_shape_tensor(pa.float16(), SHAPE)
    cells = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), SHAPE[0] * SHAPE[1]))
    start = np.arange(n) * SHAPE[0]
    last = np.minimum(start + SHAPE[0], len(frames)) - 1
    batch = pa.RecordBatch.from_arrays([cells, pa.array(start * HOP / OUT_RATE), pa.array((last * HOP + FRAME) / OUT_RATE)], names=["frames", "start", "end"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue()


def features(media: bytes | None) -> tuple[int, bytes, list[tuple[float, float]]] | None:
    """(frames, tensors, segments) of a WAV file."""
    samples = from_wav(media)
    if samples is None:
        return None
    signal = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    frames = log_mel(resample(signal))
    return len(frames), tensors(frames), segments(frames.mean(1))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a WAV file, filled up with blanks."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(1).to_pylist()
                media = [to_wav(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    slim = df.select(df[id_col].cast("long").alias("doc_id"), text_bytes(df, text_col).alias("text"))
    return slim.mapInArrow(each, "doc_id long, n_bytes long, media binary")


def audio_features(media: DataFrame) -> DataFrame:
    """Features of the column ``media`` (a WAV file), beside doc_id and n_bytes."""
    span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                files = part.column(2).to_pylist()
                found = [features(x) for x in files]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([from_wav(x) for x in files], pa.binary()), part.column(2),
                     pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.binary()),
                     pa.array([f and [{"start": a, "end": b} for a, b in f[2]] for f in found], span)],
                    names=["doc_id", "n_bytes", "payload", "media", "n_frames", "tensors", "segments"],
                )

    slim = media.select("doc_id", "n_bytes", "media")
    return slim.mapInArrow(each, "doc_id long, n_bytes long, payload binary, media binary, n_frames long, tensors binary, segments array<struct<start: double, end: double>>")


def media_report(df: DataFrame, **columns: str) -> DataFrame:
    """Store the texts of ``df`` as media and the media's features as tensors with spans, read both back, and tell what was stored and found."""
    stored = materialise(text_media(df, **columns), "media")
    size = F.octet_length("payload").cast("long")
    found = audio_features(stored).select(
        "doc_id", "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "n_frames", "tensors", "segments",
    )
    kept = materialise(found, "tensors")
    discard(stored)
    feature = F.concat_ws(":", "n_frames", F.size("segments"), F.sha2("tensors", 256), F.sha2(F.to_json("segments").cast("binary"), 256))
    return kept.withColumn("n_segments", F.size("segments").cast("long")).withColumn("feature", feature).drop("tensors", "segments")

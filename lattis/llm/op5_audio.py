"""Media columns: bytes stored as 8-bit audio, and features computed from the stored bytes.

store() keeps a payload losslessly as an 8-bit mono WAV file in a binary column. features() reads the stored bytes
back: a windowed-sinc polyphase filter halves the rate, overlapped Hann frames go through a mel filterbank (log
energies), and a two-threshold (hysteresis) segmentation of frame energy gives time spans. Both the filterbank
frames (clips of CLIP x MELS, the last padded with the floor) and the spans are written as one Arrow IPC stream with
a fixed-shape tensor column, one stream for each row. Texts are worked through in blocks of BLOCK samples with the
overlap carried, so memory doesn't grow with a text's length beyond the features themselves.

Defined results: a null text counts as empty (64 zero bytes are stored); doc_id is carried as it is; extra columns are
ignored; repeated rows give repeated, equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattis.llm.work import slices, texts

UNIT = 64
RATE = 8000
DOWN = 2
TAPS = 32
FRAME, HOP = 128, 64
MELS, CLIP = 16, 32
BLOCK = 1 << 18
FLOOR = 1e-6
#: Hysteresis: a segment starts at frames HIGH dB above the text's median energy and lasts while above LOW dB.
HIGH, LOW = 1.5, 0.5


def wav(payload: bytes) -> bytes:
    """payload as the samples of an 8-bit mono WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file as written by wav()."""
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _sinc() -> np.ndarray:
    n = np.arange(TAPS) - (TAPS - 1) / 2
    h = np.sinc(n / DOWN) * np.hamming(TAPS)
    return (h / h.sum()).astype(np.float32)


def _mel() -> np.ndarray:
    """Triangular filters over the bins of a FRAME-point FFT at the lower rate, (bins, MELS)."""
    rate = RATE / DOWN
    to, back = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = back(np.linspace(to(60.0), to(rate / 2), MELS + 2))
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


SINC, MEL, HANN = _sinc(), _mel(), np.hanning(FRAME).astype(np.float32)
#: The phases of the filter: phase p holds the taps that meet samples p, p + DOWN, ...
PHASES = SINC.reshape(-1, DOWN).T.copy()


def _half(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by 1 / DOWN of samples that carry TAPS - DOWN samples of history in front."""
    n = (len(x) - TAPS) // DOWN + 1
    out = np.zeros(n, np.float32)
    for p in range(DOWN):
        out += np.convolve(x[p::DOWN][: n + len(PHASES[p]) - 1], PHASES[p][::-1], "valid")
    return out


def log_mel(pcm: bytes) -> np.ndarray:
    """(frames, MELS) log energies of 8-bit samples."""
    x = np.frombuffer(pcm, np.uint8)
    history, rest, out = np.full(TAPS - DOWN, 0, np.float32), np.zeros(0, np.float32), []
    for at in range(0, len(x), BLOCK):
        block = (x[at : at + BLOCK].astype(np.float32) - 128) / 128
        block = np.concatenate([history, block])
        low = np.concatenate([rest, _half(block)])
        history = block[-(TAPS - DOWN) :]
        last = at + BLOCK >= len(x)
        if last:
            low = np.pad(low, (0, max(FRAME - len(low), -(len(low) - FRAME) % HOP)))
        n = max(0, (len(low) - FRAME) // HOP + 1)
        if n:
            frames = np.lib.stride_tricks.sliding_window_view(low, FRAME)[:: HOP][:n] * HANN
            power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
            out.append(np.log(np.maximum(power @ MEL, FLOOR)).astype(np.float32))
            rest = low[n * HOP :]
        else:
            rest = low
    return np.concatenate(out)


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Spans in seconds: from each frame HIGH dB over the median, extended both ways while LOW dB over it."""
    db = 10 * np.log10(np.exp(mel.astype(np.float64)).sum(axis=1))
    db -= np.median(db)
    low = np.concatenate([[False], db > LOW, [False]])
    edges = np.flatnonzero(low[1:] != low[:-1]).reshape(-1, 2)
    peaks = np.concatenate([[0], np.cumsum(db > HIGH)])
    step = HOP * DOWN / RATE
    return [(a * step, b * step) for a, b in edges[peaks[edges[:, 1]] > peaks[edges[:, 0]]].tolist()]


def tensor_bytes(mel: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow IPC stream: a fixed-shape tensor column of clips (CLIP x MELS), and each clip's time span and the
    energy segments that begin in it."""
    clips = -(-len(mel) // CLIP)
    full = np.full((clips * CLIP, MELS), np.log(FLOOR), np.float32)
    full[: len(mel)] = mel
    seconds = CLIP * HOP * DOWN / RATE
    starts = np.arange(clips) * seconds
    inside = [[] for _ in range(clips)]
    for a, b in spans:
        inside[min(clips - 1, int(a / seconds))].append({"start": a, "end": b})
    table = pa.record_batch({
        "clip": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(clips, CLIP, MELS)),
        "start": pa.array(starts), "end": pa.array(np.minimum(starts + seconds, len(mel) * HOP * DOWN / RATE)),
        "segments": pa.array(inside, pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))),
    })
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_batch(table)
    return sink.getvalue()


def read_tensor(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


STORED = "doc_id long, n_bytes long, media binary"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = texts(batch.column("text"))
    media = [wav(t + b"\0" * (-len(t) % UNIT or (0 if t else UNIT))) for t in raw]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _featured(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for media in batch.column("media").to_pylist():
        mel = log_mel(samples(media))
        out.append(tensor_bytes(mel, segments(mel)))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "tensor"])


def _digested(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for media, tensor in zip(batch.column("media").to_pylist(), batch.column("tensor").to_pylist(), strict=True):
        payload, table = samples(media), read_tensor(tensor)
        clips = table.column("clip").to_numpy_ndarray()
        spans = [[x["start"], x["end"]] for s in table.column("segments").to_pylist() for x in s]
        mean = [round(float(v), 2) for v in clips.mean(axis=(0, 1))]
        text = json.dumps({"clips": len(clips), "segments": len(spans), "spans": spans, "mel": mean, "tensor_sha256": hashlib.sha256(np.ascontiguousarray(clips)).hexdigest()})
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), text))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
        names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (before padding), media: the text's bytes, padded to a multiple of UNIT, as a WAV file."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: map(_stored, slices(batches)), STORED)


def features(stored: DataFrame) -> DataFrame:
    """stored, with tensor (an Arrow IPC stream, see tensor_bytes) read from its media column."""
    return stored.mapInArrow(lambda batches: map(_featured, slices(batches)), STORED + ", tensor binary")


def digest(featured: DataFrame) -> DataFrame:
    """Digests of the stored form and of the features, a row for each row."""
    return featured.mapInArrow(lambda batches: map(_digested, slices(batches)), DIGESTS)


def analyse(docs: DataFrame) -> DataFrame:
    """digest(features(store(docs))) in one pass through Python, few rows at a time: media and tensors stay in the worker."""
    return docs.select("doc_id", "text").mapInArrow(lambda batches: (_digested(_featured(_stored(b))) for b in slices(batches, 100)), DIGESTS)

"""Audio features of media columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

Media are 8-bit mono WAV files in a binary column. Features are floats of a fixed shape per stretch of frames, kept
as Arrow fixed-shape tensors with the time span that each covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import materialise

UNIT = 64


@dataclass(frozen=True)
class Params:
    """Rates in Hz, frame sizes in samples after resampling; a tensor holds ``span`` frames of ``mels`` values."""

    rate: int = 16_000
    target_rate: int = 8_000
    taps: int = 24
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 24
    span: int = 32
    high: float = 0.5
    low: float = -0.5
    block: int = 4096


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT))


def to_wav(payload: bytes, rate: int = 16_000) -> bytes:
    """A WAV file of unsigned 8-bit mono samples; payloads have an even length, so no pad byte is needed."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono WAV file; its chunks are walked, not assumed."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is supported")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """Hann-windowed sinc, ``taps`` for each phase of the larger factor, gain ``up``."""
    n = taps * max(up, down) + 1
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n)
    return (up * h / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """Rate change by up/down: output i uses only the filter phase and the samples that meet it (no zero-stuffing)."""
    if up == down or not len(x):
        return x
    h = _low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    centre = (len(h) - 1) // 2
    period = up // np.gcd(up, down)
    for p in range(period):  # outputs p, p + period, ... share one phase of the filter
        k = np.arange(p, n, period)
        if not len(k):
            continue
        first = k[0] * down + centre
        phase = first % up
        sub = h[phase::up]
        newest = first // up
        step = period * down // up
        padded = np.concatenate([np.zeros(len(sub), np.float32), x, np.zeros(max(0, newest + step * (len(k) - 1) + 1 - len(x)), np.float32)])
        # output j = sum_m sub[m] * x[newest + j * step - m]
        parts = np.zeros(len(k), np.float32)
        base = newest + len(sub)
        for m, c in enumerate(sub):
            parts += c * padded[base - m : base - m + step * (len(k) - 1) + 1 : step]
        out[k] = parts
    return out


@lru_cache(maxsize=8)
def _mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    up = (bins[:, None] - points[:-2]) / np.diff(points)[:-1]
    down = (points[2:] - bins[:, None]) / np.diff(points)[1:]
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(samples: bytes, rate: int, p: Params) -> np.ndarray:
    """Log-mel energies, frames by ``p.mels``; at least one frame. Frames are taken in blocks of bounded size."""
    g = int(np.gcd(rate, p.target_rate))
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x, p.target_rate // g, rate // g, p.taps)
    n = 1 + max(0, -(-(len(x) - p.frame) // p.hop))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * p.hop + p.frame - len(x)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, p.frame)[:: p.hop]
    window, bank = np.hanning(p.frame).astype(np.float32), _mel_bank(p.target_rate, p.fft, p.mels)
    out = np.empty((n, p.mels), np.float32)
    for at in range(0, n, p.block):
        spectrum = np.fft.rfft(frames[at : at + p.block] * window, p.fft)
        out[at : at + p.block] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + 1e-6)
    return out


def segments(energy: np.ndarray, high: float, low: float) -> list[tuple[int, int]]:
    """Stretches [first, last) of frames: they begin above ``high`` and last until the energy falls below ``low``."""
    event = np.where(energy > high, 1, np.where(energy < low, 0, -1))
    last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
    active = np.where(last >= 0, event[np.maximum(last, 0)], 0)
    edges = np.flatnonzero(np.diff(active, prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def active_spans(mel: np.ndarray, p: Params) -> list[tuple[int, int]]:
    """Segments by the mean log energy, standardised over the whole recording."""
    energy = mel.mean(axis=1, dtype=np.float64)
    sd = energy.std()
    return segments((energy - energy.mean()) / sd, p.high, p.low) if sd > 1e-9 else []


def summary(mel: np.ndarray, spans: list[tuple[int, int]], parts: int, p: Params) -> str:
    """A short text that depends on every frame and segment."""
    ms = 1000 * p.hop // p.target_rate
    flat = np.array(spans, np.int64).tobytes()
    mean = np.rint(mel.mean(axis=0, dtype=np.float64) * 100).astype(int)
    return f"frames={len(mel)};tensors={parts};segments={len(spans)};active_ms={ms * sum(b - a for a, b in spans)};spans_crc32={zlib.crc32(flat)};mean_mel_x100={','.join(map(str, mean))}"


def media_of(docs: DataFrame, rate: int = 16_000) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a WAV file in a binary column. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [to_wav(payload_of(t), rate) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parts_of(mel: np.ndarray, spans: list[tuple[int, int]], p: Params) -> tuple[list[np.ndarray], np.ndarray]:
    """([part, start_ms, end_ms, active_frames], frames) of the tensors of a recording; the last frame fills the last one up."""
    active = np.zeros(len(mel) + (-len(mel)) % p.span, np.int64)
    for a, b in spans:
        active[a:b] = 1
    parts = len(active) // p.span
    full = np.concatenate([mel, np.repeat(mel[-1:], len(active) - len(mel), axis=0)])
    ms, at = 1000 * p.hop / p.target_rate, np.arange(parts) * p.span
    return [at // p.span, at * ms, np.minimum(at + p.span, len(mel)) * ms, active.reshape(parts, -1).sum(axis=1)], full


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def _joined(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(np.concatenate(arrays) if arrays else [], kind)


def tensors(media: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, part, start_ms, end_ms, active_frames, tensor): ``p.span`` frames by ``p.mels`` floats each, row by row.

    The last part of a recording is filled up with its last frame; end_ms tells where it really ends. Null media give
    no rows.
    """
    made = recordings(media.where("media is not null").select("doc_id", F.lit(0).cast("long").alias("n_bytes"), "media"), p)
    return made.select("doc_id", F.explode("tensors").alias("t")).select("doc_id", "t.*")


def as_tensor_table(table: pa.Table, p: Params = Params()) -> pa.Table:
    """The Arrow table with its tensor column as Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), (p.span, p.mels))
    values = pa.chunked_array([c.flatten() for c in table["tensor"].chunks], pa.float32()).combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    storage = pa.FixedSizeListArray.from_arrays(values, p.span * p.mels)
    return table.set_column(table.column_names.index("tensor"), "tensor", pa.ExtensionArray.from_storage(kind, storage))


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
#: How media and tensors are written: zstd, and no dictionaries, which only take room beside floats that hardly repeat.
_PACKED = {"compression": "zstd", "parquet.enable.dictionary": "false"}
#: Texts gain from a higher level and longer pages; floats do not.
_PACKED_MEDIA = _PACKED | {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: Rows whose tensors are held at once.
_ROWS = 256


def recordings(media: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each of ``media_of``'s rows: digests of its bytes, its segments and its tensors with their time spans.

    Segments are (start_ms, end_ms); tensors are the rows of ``tensors``, in order. Null media raise.
    """
    ms = 1000 * p.hop / p.target_rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                rows, spans, parts, frames = [], [], [], []
                for media in batch.column(2).to_pylist():
                    rate, samples = from_wav(media)
                    rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
                    mel = log_mel(samples, rate, p)
                    spans.append(active_spans(mel, p))
                    made = parts_of(mel, spans[-1], p)
                    parts.append(made[0])
                    frames.append(made[1].reshape(-1))
                digests = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                edges = np.array([e for own in spans for e in own], np.float64).reshape(-1, 2) * ms
                segment = pa.StructArray.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["start_ms", "end_ms"])
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
                columns = [_joined([own[k] for own in parts], kind) for k, kind in enumerate(kinds)]
                tensor = _lists([p.span * p.mels] * len(columns[0]), _joined(frames, pa.float32()))
                part = pa.StructArray.from_arrays([*columns, tensor], ["part", "start_ms", "end_ms", "active_frames", "tensor"])
                lists = [_lists([len(own) for own in spans], segment), _lists([len(own[0]) for own in parts], part)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors"]
                yield pa.record_batch([batch.column(0), batch.column(1), *digests, *lists], ["doc_id", "n_bytes", *names])

    made = "segments array<struct<start_ms double, end_ms double>>, tensors array<struct<part long, start_ms double, end_ms double, active_frames long, tensor array<float>>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{_DIGESTS}, {made}")


def digested(made: DataFrame, p: Params = Params()) -> DataFrame:
    """The columns of ``recordings`` with ``feature``, made from the segments and tensors, in place of these."""
    ms = 1000 * p.hop / p.target_rate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for segments_, tensors_ in zip(batch.column(7), batch.column(8), strict=True):
                spans = [(round(r["start_ms"] / ms), round(r["end_ms"] / ms)) for r in segments_.as_py()]
                parts = tensors_.values
                frames = round(parts.field("end_ms")[-1].as_py() / ms)
                mel = parts.field("tensor").flatten().to_numpy(zero_copy_only=False).reshape(-1, p.mels)[:frames]
                features.append(summary(mel, spans, len(parts), p))
            yield pa.record_batch([*batch.columns[:7], pa.array(features, pa.string())], [*batch.schema.names[:7], "feature"])

    return made.mapInArrow(run, f"{_DIGESTS}, feature string")


def features_of(media: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row of
    ``media_of``'s columns; all but n_bytes comes from the media, ``feature`` by way of their tensors. Null media raise."""
    return digested(recordings(media, p), p)


def audio_features(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``features_of`` the media of every row's text, which pass on without being stored.

    Empty and null texts are 64 zero bytes. Equal texts give equal values, since each recording is computed by itself.
    Repeated rows stay; an empty table gives an empty result.
    """
    return features_of(media_of(docs, p.rate), p)


def stored_features(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``audio_features``, from media written as a table in the shared folder and read back."""
    return features_of(materialise(media_of(docs, p.rate), "media"), p)


def stored_recordings(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``recordings`` of every row's text: media are written as a table in the shared folder and read back, and the
    segments and tensors made of them are written as another, which is the result."""
    media = materialise(media_of(docs, p.rate), "media", _PACKED_MEDIA)
    return materialise(recordings(media, p), "tensors", _PACKED)

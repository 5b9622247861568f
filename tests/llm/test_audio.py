import hashlib
import io
import wave
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from parlance.llm import _common, audio, queries


@pytest.fixture(scope="module", params=["documents", "edge"])
def table(request):
    return request.getfixturevalue(request.param)


def test_contract(table):
    features = {}
    for row, r in zip(table.select("doc_id", "text").collect(), audio.audio_features(table).collect(), strict=True):
        raw = (row["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = io.BytesIO()
        with wave.open(stored, "wb") as w:
            w.setparams((1, 1, 16_000, 0, "NONE", ""))
            w.writeframes(payload)
        media = stored.getvalue()
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (row["doc_id"], len(raw), len(payload), zlib.crc32(payload[-64:]), len(media))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert features.setdefault(payload, r["feature"]) == r["feature"]


def test_round_trip_and_bad_files():
    for n in (64, 128, 6400):
        payload = bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8))
        assert audio.from_wav(audio.to_wav(payload, 8_000)) == (8_000, payload)
    for bad in (b"", b"RIFF1234WAVE", b"x" * 100):
        with pytest.raises(ValueError):
            audio.from_wav(bad)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (3, 2), (2, 3), (1, 1)])
def test_resampling_is_filtering_after_zero_stuffing(up, down):
    x = np.random.default_rng(0).normal(size=257).astype(np.float32)
    if up == down:
        assert audio.resample(x, up, down, 8) is x
        return
    h = audio._low_pass(up, down, 8)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, h)
    centre, n = (len(h) - 1) // 2, -(-len(x) * up // down)
    expected = np.array([full[centre + k * down] for k in range(n)])
    assert np.allclose(audio.resample(x, up, down, 8), expected, atol=1e-4)


def test_log_mel_by_frame():
    p = audio.Params(target_rate=16_000)
    samples = bytes(np.random.default_rng(2).integers(0, 256, 1000, np.uint8))
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    mel = audio.log_mel(samples, 16_000, p)
    assert len(mel) == 1 + -(-(1000 - p.frame) // p.hop)
    x = np.concatenate([x, np.zeros(p.frame)])
    for k in (0, 3, len(mel) - 1):
        power = np.abs(np.fft.rfft(x[k * p.hop : k * p.hop + p.frame] * np.hanning(p.frame), p.fft)) ** 2
        assert np.allclose(mel[k], np.log(power @ audio._mel_bank(16_000, p.fft, p.mels) + 1e-6), atol=1e-2)


def test_hysteresis():
    assert audio.segments(np.array([0, 1, 0.2, 0, -1, 0.2, 2, -2.0]), 0.5, -0.5) == [(1, 4), (6, 7)]
    assert audio.segments(np.zeros(5), 0.5, -0.5) == []
    assert audio.segments(np.array([3.0, 3.0]), 0.5, -0.5) == [(0, 2)]


def test_tensors(spark, edge):
    p = audio.Params()
    media = audio.media_of(edge.where("doc_id in (4, 7, 10)"))
    rows = audio.tensors(media, p).toArrow()
    table = audio.as_tensor_table(rows, p)
    kind = table.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [p.span, p.mels]
    assert table.num_rows == rows.num_rows and min(table["end_ms"].to_pylist()) > 0
    spans = sorted((a, b) for i, a, b in zip(rows["doc_id"].to_pylist(), rows["start_ms"].to_pylist(), rows["end_ms"].to_pylist(), strict=True) if i == 4)
    assert all(b == c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_stored_features_come_from_the_written_media(spark, table):
    first = len(_common.WRITTEN)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["media_sha256"])
    found = sorted(audio.stored_features(table).collect(), key=key)
    assert found == sorted(audio.audio_features(table).collect(), key=key)
    (path,) = _common.WRITTEN[first:]
    assert sorted(hashlib.sha256(r["media"]).hexdigest() for r in spark.read.parquet(path).collect()) == sorted(r["media_sha256"] for r in found)


def test_features_come_from_written_tensors(spark, table):
    p, first = audio.Params(), len(_common.WRITTEN)
    made = audio.stored_recordings(table, p)
    media, tensors = _common.WRITTEN[first:]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["media_sha256"])
    found = {key(r): r["feature"] for r in audio.digested(made, p).collect()}
    assert found == {key(r): r["feature"] for r in audio.audio_features(table, p).collect()}
    stored = {hashlib.sha256(r["media"]).hexdigest(): r["media"] for r in spark.read.parquet(media).collect()}
    for r in spark.read.parquet(tensors).collect():
        rate, samples = audio.from_wav(stored[r["media_sha256"]])
        mel = audio.log_mel(samples, rate, p)
        assert [t["part"] for t in r["tensors"]] == list(range(-(-len(mel) // p.span))) and r["tensors"][-1]["end_ms"] == 10.0 * len(mel)
        assert all(len(t["tensor"]) == p.span * p.mels for t in r["tensors"])
        assert np.array_equal(np.concatenate([t["tensor"] for t in r["tensors"]]).reshape(-1, p.mels)[: len(mel)].astype(np.float32), mel)
        assert [(x["start_ms"], x["end_ms"]) for x in r["segments"]] == [(10.0 * a, 10.0 * b) for a, b in audio.active_spans(mel, p)]
        mean = np.rint(mel.mean(axis=0, dtype=np.float64) * 100).astype(int)
        assert found[key(r)].startswith(f"frames={len(mel)};tensors={len(r['tensors'])};") and found[key(r)].endswith("=" + ",".join(map(str, mean)))


def test_the_query_writes_tensors(spark, sf):
    first = len(_common.WRITTEN)
    queries.op6_audio_features(spark, sf).count()
    assert "tensors" in spark.read.parquet(_common.WRITTEN[first:][-1]).columns


def test_empty(empty):
    assert audio.digested(audio.stored_recordings(empty)).count() == 0
    assert audio.stored_features(empty).count() == 0
    assert audio.audio_features(empty).count() == 0


def test_media_are_packed_closely(spark, documents, tmp_path):
    first = len(_common.WRITTEN)
    audio.stored_recordings(documents)
    audio.media_of(documents).write.options(**audio._PACKED).parquet(f"{tmp_path}/media")
    size = lambda path: sum(f.stat().st_size for f in Path(path.removeprefix("file://")).glob("*.parquet"))
    assert 0 < size(_common.WRITTEN[first]) < 0.95 * size(f"{tmp_path}/media")

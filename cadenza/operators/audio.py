"""Sound in and out: rendered PCM, WAV bytes, pauses, peaks and acoustic measures of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nodes import SAMPLE_RATE, pause_ms, voice

#: Frames, floors and limits of the acoustic measures.
FRAME_MS, SILENCE_DB, LEAST_PAUSE_MS, PEAK_DROP_DB = 10, -40.0, 200, 5.0
F0_LOW, F0_HIGH = 75.0, 600.0
WORD_S, GAP_S, FADE_S, UTTERANCE_S, EMPTY_S = 0.25, 0.05, 0.005, 0.3, 0.1


@lru_cache(16)
def _envelope(n: int) -> np.ndarray:
    """Loudness of a tone of ``n`` samples: rising from silence at its start, falling to it at its end."""
    from_end = np.minimum(np.arange(n), np.arange(n)[::-1])
    ramp = min(round(SAMPLE_RATE * FADE_S), n // 2)
    return np.minimum(from_end / max(1, ramp - 1), 1.0)


@lru_cache(256)
def tone(frequency: float, seconds: float, amplitude: float) -> np.ndarray:
    """A faded sine.  Words of one voice share one array."""
    phase = np.arange(int(SAMPLE_RATE * seconds)) * (2 * np.pi * frequency / SAMPLE_RATE)
    out = np.sin(phase) * _envelope(len(phase)) * amplitude
    out.setflags(write=False)
    return out


def _pcm(samples: np.ndarray) -> bytes:
    return (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()


@lru_cache(256)
def _spoken(frequency: float, amplitude: float) -> bytes:
    return _pcm(tone(frequency, WORD_S, amplitude))


def _still(seconds: float) -> bytes:
    return bytes(2 * int(SAMPLE_RATE * seconds))


def _riff(frames: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(frames)
    return out.getvalue()


def wav_bytes(samples: np.ndarray) -> bytes:
    """Mono 16-bit RIFF."""
    return _riff(_pcm(samples))


#: Bytes of sound after which a batch is handed on.
_BATCH_BYTES = 8 << 20


def rendered(nodes: DataFrame) -> DataFrame:
    """(doc_id, wav): each document that parses as sound; its parts meet by doc_id, as they must in
    its file, and Python renders many documents a batch.  A pause of negative length is none."""
    still = F.when((F.col("kind") == "pause") & ~F.col("hidden"), F.greatest(pause_ms(), F.lit(0)))
    root = (F.col("depth") == 0) & F.col("kind").isin("iml", "utterance")
    heard = F.col("inside") & (F.col("kind").isin("text", "utterance") | still.isNotNull())
    rows = nodes.where(root | heard).withColumn("v", F.when(F.col("kind") == "text", voice()))
    part = F.struct("utt_idx", "pre", still.alias("ms"), "text", F.col("v.f").alias("frequency"), F.col("v.a").alias("amplitude"))
    docs = rows.select("doc_id", root.alias("root"), F.when(heard, part).alias("part")).groupBy("doc_id").agg(F.bool_or("root").alias("parses"), F.array_sort(F.collect_list("part")).alias("parts"))

    def frames(parts: list[tuple]) -> bytes:
        out, last = [], None
        for utterance, ms, text, frequency, amplitude in parts:
            if last is not None and utterance != last:
                out.append(_still(UTTERANCE_S))
            last = utterance
            if ms is not None:
                out.append(_still(ms / 1000.0))
            for k, _ in enumerate((text or "").split()):
                if k:
                    out.append(_still(GAP_S))
                out.append(_spoken(frequency, amplitude))
        return b"".join(out) or _still(EMPTY_S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda ids, wavs: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wavs, pa.binary())], ["doc_id", "wav"])
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            parts = list(zip(*(flat.field(c).to_pylist() for c in ("utt_idx", "ms", "text", "frequency", "amplitude")), strict=True))
            ids, wavs, held, at = [], [], 0, 0
            for doc, n in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist(), strict=True):
                ids.append(doc)
                wavs.append(_riff(frames(parts[at : at + n])))
                at, held = at + n, held + len(wavs[-1])
                if held >= _BATCH_BYTES:
                    yield made(ids, wavs)
                    ids, wavs, held = [], [], 0
            yield made(ids, wavs)

    return docs.where("parses").select("doc_id", "parts").mapInArrow(run, "doc_id long, wav binary")


def write_wavs(sounds: DataFrame, folder: str) -> None:
    """One file for each row of (doc_id, wav) in a folder that the executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        for batch in batches:
            for doc, data in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                with fs.open_output_stream(f"{root}/{doc}.wav") as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    sounds.select("doc_id", "wav").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_samples(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1] and the rate of a mono or stereo 16-bit file."""
    with wave.open(io.BytesIO(data)) as w:
        raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
        return raw.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()


def measures(samples: np.ndarray, rate: int) -> dict[str, float | None]:
    """f0_mean, f0_low, f0_high by autocorrelation, intensity_mean in dB, jitter, shimmer and hnr of a
    span; what cannot be measured is None.  Stand-ins for a phonetics library, alike in kind."""
    out: dict[str, float | None] = dict.fromkeys(("f0_mean", "f0_low", "f0_high", "intensity_mean", "jitter", "shimmer", "hnr"))
    if not len(samples):
        return out
    power = float(np.mean(samples**2))
    if power > 0:
        out["intensity_mean"] = 10 * np.log10(power / 4e-10)
    size, step = int(rate * 0.04), int(rate * FRAME_MS / 1000)
    lags = slice(int(rate / F0_HIGH), int(rate / F0_LOW))
    periods, peaks, harmonic = [], [], []
    for a in range(0, max(0, len(samples) - size), step):
        frame = samples[a : a + size] - samples[a : a + size].mean()
        energy = float(frame @ frame)
        if energy / size < 1e-6:
            continue
        spectrum = np.fft.rfft(frame, 2 * size)
        auto = np.fft.irfft(spectrum * np.conj(spectrum))[:size] / energy
        auto = auto / np.maximum(1 - np.arange(size) / size, 0.1)
        part = auto[lags]
        top = (part[1:-1] >= part[:-2]) & (part[1:-1] >= part[2:]) & (part[1:-1] > 0.9 * part.max())
        # the shortest of about equal periods, not a multiple of it
        best = lags.start + (int(np.argmax(top)) + 1 if top.any() else int(np.argmax(part)))
        if auto[best] > 0.45:
            periods.append(best / rate)
            peaks.append(float(np.abs(frame).max()))
            harmonic.append(min(float(auto[best]), 0.9999))
    if periods:
        f0 = 1 / np.array(periods)
        out |= {"f0_mean": float(f0.mean()), "f0_low": float(f0.min()), "f0_high": float(f0.max())}
        out["hnr"] = float(np.mean([10 * np.log10(h / (1 - h)) for h in harmonic]))
        if len(periods) > 1:
            out["jitter"] = float(np.mean(np.abs(np.diff(periods))) / np.mean(periods))
            out["shimmer"] = float(np.mean(np.abs(np.diff(peaks))) / np.mean(peaks))
    return out


def span_measures(spans: DataFrame) -> DataFrame:
    """``spans`` (path, start_ms, end_ms, content WAV bytes) with the measures of each span, cut to
    the file's length; a file is decoded once for its spans."""
    names = ["f0_mean", "f0_low", "f0_high", "intensity_mean", "jitter", "shimmer", "hnr"]

    def run(t: pa.Table) -> pa.Table:
        samples, rate = read_samples(t["content"][0].as_py())
        rows = []
        for a, b in zip(t["start_ms"].to_pylist(), t["end_ms"].to_pylist(), strict=True):
            lo, hi = max(0, a * rate // 1000), min(len(samples), b * rate // 1000)
            rows.append(measures(samples[lo:hi], rate))
        return pa.table({"path": t["path"], "start_ms": t["start_ms"], "end_ms": t["end_ms"], **{n: pa.array([r[n] for r in rows], pa.float64()) for n in names}})

    kinds = "path string, start_ms long, end_ms long, " + ", ".join(f"{n} double" for n in names)
    return spans.select("path", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"), "content").groupBy("path").applyInArrow(run, kinds)


def silent_runs(frames: DataFrame, duration_ms: DataFrame, least_ms: int = LEAST_PAUSE_MS, floor_db: float = SILENCE_DB) -> DataFrame:
    """(path, start_ms, end_ms) of runs of silent frames (path, frame, db) of at least ``least_ms``;
    a run up to the last frame ends with the file (path, duration_ms)."""
    order = Window.partitionBy("path").orderBy("frame")
    still = F.coalesce(F.col("db"), F.lit(-1e9)) < floor_db
    marked = frames.withColumn("last", F.max("frame").over(Window.partitionBy("path"))).where(still)
    runs = marked.withColumn("g", F.col("frame") - F.row_number().over(order)).groupBy("path", "g").agg(F.min("frame").alias("a"), F.max("frame").alias("z"), F.first("last").alias("last"))
    timed = runs.join(duration_ms, "path")
    end = F.when(F.col("z") == F.col("last"), F.col("duration_ms")).otherwise((F.col("z") + 1) * FRAME_MS)
    return timed.select("path", (F.col("a") * FRAME_MS).alias("start_ms"), end.alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def peaks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_peaks, n_frames): frames louder than both neighbours and than the mean less
    ``PEAK_DROP_DB``, by which syllables are counted."""
    order = Window.partitionBy(*keys).orderBy("frame")
    mean = F.avg("db").over(Window.partitionBy(*keys))
    top = (F.col("db") > F.lag("db").over(order)) & (F.col("db") > F.lead("db").over(order)) & (F.col("db") > mean - PEAK_DROP_DB)
    return frames.withColumn("top", F.coalesce(top, F.lit(False))).groupBy(*keys).agg(F.count_if("top").alias("n_peaks"), F.count("*").alias("n_frames"))

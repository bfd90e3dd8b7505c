"""Media columns: audio features of 8-bit recordings.

:func:`encode_wav` stores 8-bit samples losslessly as a WAV file;
:func:`features` turns samples into log-mel windows: polyphase resampling from
8 to 12 kHz, overlapped frames through a mel filterbank, and hysteresis
segmentation on frame energy.  Segments are cut to windows of ``WINDOW`` frames,
stored as an Arrow fixed-shape tensor column beside their time spans, one stream
for each document; the query reads the streams again and derives the features'
digest, the number of windows and the voiced time from what it has read.  It
takes the documents in ``SLICES`` parts and deletes a part's streams when their
features are derived, so that they do not all stand on disk at once.

Nulls, ties and edges: a null text is empty; an empty payload is one block of
zeros; silence gives no segment, and then a stream of no rows; repeated rows and
a null doc_id get a result row each; long texts are resampled and framed in
slices of ``SLICE`` samples with the overlap that taps and frames need: beside the
text, its log-mel frames (2 bytes a byte), the windows cut from them and their
stream are in memory, and nothing else grows with it; other columns are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .words import utf8

BLOCK = 64
RATE_IN, UP, DOWN = 8_000, 3, 2
RATE = RATE_IN * UP // DOWN
#: Taps of each phase of the resampling filter.
TAPS = 8
#: 25 ms frames every 10 ms; a hop is a whole number of UP samples.
FRAME, HOP, FFT, MELS = 300, 120, 512, 40
#: Frames of a stored window.
WINDOW = 64
#: Energy, as a share of the loudest frame's, that opens and that keeps a segment.
OPEN, KEEP = 0.25, 0.08
#: Samples that are framed at once.
SLICE = 1 << 18
#: Bytes of streams in a batch of rows and of windows in a batch of a stream; a row or window above it stands alone.
BATCH_BYTES = 8 << 20
#: Rows of media and streams that are read at once, and bytes of them that go to Python at once.
READ_ROWS, READ_BYTES = 128, 16 << 20
#: Parts in which the query takes the documents.
SLICES = 8
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def pad(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of ``BLOCK``."""
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def encode_wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono PCM in a RIFF container."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", n) + payload + bytes(n % 2)


def decode_wav(media: bytes) -> bytes:
    """The samples of a file that :func:`encode_wav` wrote."""
    riff, _, wave, fmt, size, kind, channels, rate, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, size, kind, channels, rate, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, 8, b"data"):
        raise ValueError("not an 8-bit mono WAV file of this rate")
    return media[HEADER.size : HEADER.size + n]


def _phases() -> np.ndarray:
    """A windowed-sinc low-pass, dealt into UP phases."""
    n = UP * TAPS
    at = np.arange(n) - (n - 1) / 2
    taps = np.sinc(at / max(UP, DOWN)) * np.hamming(n)
    return (taps / taps.sum() * UP).reshape(TAPS, UP).T.astype(np.float32)


def _mel_bank() -> np.ndarray:
    """Triangles, evenly spaced in mel, over the bins of an FFT."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(RATE / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


PHASES, BANK = _phases(), _mel_bank()
HANN = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def resample(samples: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Output samples ``lo`` (a multiple of UP) to ``hi`` of 8-bit samples, with silence around them; only these are computed, each by its phase."""
    first, last = lo // UP * DOWN - TAPS // 2, (hi - 1) * DOWN // UP - TAPS // 2 + TAPS
    part = samples[max(0, first) : max(0, min(len(samples), last))]
    x = np.zeros(last - first, np.float32)
    x[max(0, -first) : max(0, -first) + len(part)] = (part.astype(np.float32) - np.float32(128)) / np.float32(128)
    taps, out = np.lib.stride_tricks.sliding_window_view(x, TAPS), np.empty(hi - lo, np.float32)
    for r in range(min(UP, hi - lo)):
        n = len(out[r::UP])
        out[r::UP] = taps[r * DOWN // UP :: DOWN][:n] @ PHASES[r * DOWN % UP][::-1]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, frame energies) of 8-bit samples; the last frame is padded with zeros."""
    total = -(-len(samples) * UP // DOWN)
    n = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    step = max(1, SLICE // HOP)
    for a in range(0, n, step):
        b = min(n, a + step)
        wave = resample(samples, a * HOP, (b - 1) * HOP + FRAME)
        wave[max(0, total - a * HOP) :] = 0
        part = np.lib.stride_tricks.sliding_window_view(wave, FRAME)[::HOP]
        energy[a:b] = np.einsum("ij,ij->i", part, part) / FRAME
        power = np.abs(np.fft.rfft(part * HANN, FFT)).astype(np.float32) ** 2
        mels[a:b] = np.log(power @ BANK + 1e-6)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that rise above OPEN and last while they stay above KEEP."""
    top = float(energy.max(initial=0))
    if top <= 0:
        return []
    loud = np.concatenate(([False], energy >= KEEP * top, [False]))
    turn = np.flatnonzero(loud[1:] != loud[:-1])
    opened = np.concatenate(([0], np.cumsum(energy >= OPEN * top)))
    return [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2], strict=True) if opened[b] > opened[a]]


def features(payload: bytes) -> tuple[list[tuple[float, float]], np.ndarray]:
    """(time spans in seconds, windows x WINDOW x MELS) of 8-bit samples."""
    samples = np.frombuffer(payload, np.uint8)
    if not samples.any() or not (samples != 128).any():
        return [], np.empty((0, WINDOW, MELS), np.float32)
    mels, energy = log_mel(samples)
    spans, cut = [], []
    for a, b in segments(energy):
        for i in range(a, b, WINDOW):
            j = min(b, i + WINDOW)
            spans.append((i * HOP / RATE, ((j - 1) * HOP + FRAME) / RATE))
            cut.append(np.pad(mels[i:j], ((0, WINDOW - (j - i)), (0, 0)), constant_values=np.float32(np.log(1e-6))))
    return spans, np.stack(cut) if cut else np.empty((0, WINDOW, MELS), np.float32)


def to_ipc(spans: list[tuple[float, float]], windows: np.ndarray) -> bytes:
    """An Arrow stream of start_s, end_s and a fixed-shape tensor column."""
    kind = pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(windows.reshape(-1)), WINDOW * MELS)
    table = pa.table({"start_s": pa.array([a for a, _ in spans], pa.float64()), "end_s": pa.array([b for _, b in spans], pa.float64()), "log_mel": pa.ExtensionArray.from_storage(kind, flat)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table, max_chunksize=max(1, BATCH_BYTES // (4 * WINDOW * MELS)))
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or b"" for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_wav(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _told(spans: list[tuple[float, float]], windows: np.ndarray) -> tuple[str, int, float]:
    """Digest of features, number of windows, voiced seconds."""
    digest = hashlib.sha256(np.rint(windows * 64).astype("<i4").tobytes() + repr(spans).encode()).hexdigest()
    return digest, len(spans), float(sum(b - a for a, b in spans))


def extract(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Per stored file: digests of what is read back, the features' digest, and with ``tensors`` their Arrow stream."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_windows long, voiced_s double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, streams = [], []
            for i in range(batch.num_rows):
                doc_id, n, blob = (batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "media"))
                payload = decode_wav(blob)
                spans, windows = features(payload)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), *_told(spans, windows)))
                if tensors:
                    streams.append(to_ipc(spans, windows))
                if len(rows) == 200 or i == batch.num_rows - 1 or sum(map(len, streams)) >= BATCH_BYTES:
                    cols = [pa.array(c) for c in zip(*rows, strict=True)]
                    cols[0] = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(streams, pa.binary())] if tensors else []), names=names + ["tensors"] * tensors)
                    rows, streams = [], []

    return media.mapInArrow(run, schema + (", tensors binary" if tensors else ""))


def read_back(stored: DataFrame) -> DataFrame:
    """The stored rows with feature, n_windows and voiced_s from their streams; a stream that is not what was made is an error."""
    derived = ("feature", "n_windows", "voiced_s")
    out = stored.drop("tensors").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for blob in batch.column("tensors"):
                table = from_ipc(blob.as_buffer())
                spans = list(zip(table.column("start_s").to_pylist(), table.column("end_s").to_pylist(), strict=True))
                parts = [c.storage.flatten().to_numpy() for c in table.column("log_mel").chunks]
                told.append(_told(spans, np.concatenate([np.empty(0, np.float32), *parts]).reshape(-1, WINDOW, MELS)))
            if [x[0] for x in told] != batch.column("feature").to_pylist():
                raise ValueError("a stored stream differs from its features")
            new = dict(zip(derived, (pa.array([x[i] for x in told], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64()))), strict=True))
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c) if c in batch.schema.names else None) for c in out.names], names=out.names)

    return stored.mapInArrow(run, out)


@contextlib.contextmanager
def _small_reads(spark: SparkSession) -> Iterator[None]:
    """What is written inside reads its large values a few at a time."""
    sizes = {"spark.sql.parquet.columnarReaderBatchSize": READ_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch": READ_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": READ_BYTES}
    was = {k: spark.conf.get(k, None) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, from the stored media column and the stored tensors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "media")
    part = F.pmod(F.xxhash64("doc_id", "n_bytes", F.crc32("media")), F.lit(SLICES)).cast("int")
    media = scratch.save(store(docs).withColumn("part", part), "wav", by="part")
    told = []
    with _small_reads(spark):
        for i in range(SLICES):
            tensors = scratch.save(extract(media.where(F.col("part") == i).drop("part")), "tensors")
            told.append(scratch.save(read_back(tensors), "features"))
            scratch.drop(tensors)
    scratch.drop(media)
    return reduce(DataFrame.unionByName, told)

"""Media columns: archives of 8-bit WAV members, and a Spark data source that reads them by byte range."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.shared import fresh_path, id_back, long_id

UNIT = 64
RATE = 8000


def to_wav(raw: bytes) -> bytes:
    """A mono 8-bit WAV whose samples are raw and zeros up to a positive multiple of UNIT; a chunk keeps raw's length."""
    samples = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
    parts = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"utf8" + struct.pack("<IQ", 8, len(raw)) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def from_wav(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, samples) of a stored member."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV member")
    at, length, samples = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        body = media[at + 8 : at + 8 + size]
        length = struct.unpack("<Q", body)[0] if kind == b"utf8" else length
        samples = body if kind == b"data" else samples
        at += 8 + size + size % 2
    if length is None or samples is None:
        raise ValueError("a WAV member lacks its length or samples")
    return length, samples


def feature(samples: bytes) -> str:
    """Mean, deviation, peak distance from the middle, crossings of the middle and a coarse spectrum centre, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    frames = x[: len(x) // UNIT * UNIT].reshape(-1, UNIT)
    power = np.zeros(UNIT // 2 + 1)
    for lo in range(0, len(frames), 4096):
        power += (np.abs(np.fft.rfft(frames[lo : lo + 4096], axis=1)) ** 2).sum(0)
    centre = float((power * np.arange(len(power))).sum() / power.sum()) if power.sum() else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};peak={int(np.abs(x).max())};cross={int((np.diff(np.signbit(x))).sum())};centre={centre:.4f}"


def store(docs: DataFrame, path: str, id_col: str, text_col: str, archive_bytes: int) -> None:
    """Writes every text as a member of a ZIP archive under path; archives are finished in memory and moved into place.

    Archive names depend on the partition alone, so a task that is run again replaces its own files with equal ones.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, n = TaskContext.get().partitionId(), 0, 0
        system, root = pafs.FileSystem.from_uri(path)
        system.create_dir(root)
        buffer, archive = io.BytesIO(), None

        def finish() -> None:
            nonlocal buffer, archive, files
            archive.close()
            scratch = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(scratch) as out:
                out.write(buffer.getbuffer())
            system.move(scratch, f"{root}/part-{part:06d}-{files:05d}.zip")
            buffer, archive, files = io.BytesIO(), None, files + 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = archive or zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                archive.writestr(f"{n}_{doc}.wav", to_wav(text.as_py()))
                n += 1
                if buffer.tell() >= archive_bytes:
                    finish()
        if archive:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["members"])

    rows = docs.select(long_id(id_col).alias("__id"), F.coalesce(F.encode(F.col(text_col), "utf-8"), F.lit(b"")).alias("__raw"))
    rows.mapInArrow(write, "members long").write.format("noop").mode("overwrite").save()


@dataclass
class ByteRange(InputPartition):
    """The members whose headers start in [start, end) of an archive."""

    archive: str
    start: int
    end: int

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.batch = int(options.get("batchbytes", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        """Plans from sizes alone; no archive is opened on the driver."""
        system, root = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        ranges = [ByteRange(f.path, lo, lo + self.split) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".zip") for lo in range(0, max(f.size, 1), self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        held: list[tuple] = []
        size = 0
        opened = self._open(system, partition.archive)
        for info in opened.infolist():
            if not partition.start <= info.header_offset < partition.end:
                continue
            media, error = None, None
            for attempt in range(self.attempts):
                try:
                    media, error = opened.read(info), None  # checks the member's CRC
                    break
                except (OSError, zlib.error, zipfile.BadZipFile, EOFError) as e:
                    error = f"{type(e).__name__}: {e}"
                    time.sleep(0.05 * attempt)
                    opened = self._open(system, partition.archive)
            held.append((info.filename, info.header_offset, media, error))
            size += len(media or b"")
            if size >= self.batch:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _open(self, system: pafs.FileSystem, archive: str) -> zipfile.ZipFile:
        for attempt in range(self.attempts):
            try:
                return zipfile.ZipFile(system.open_input_file(archive))
            except (OSError, zipfile.BadZipFile):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * (attempt + 1))
        raise OSError(archive)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "offset", "media", "error"])


class MediaArchives(DataSource):
    """format("tessera_media"): one row per archive member; error says why a member could not be read after all attempts."""

    @classmethod
    def name(cls) -> str:
        return "tessera_media"

    def schema(self) -> str:
        return "member string, offset long, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def members(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """The members of all archives under path."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("tessera_media").options(path=path, **options).load()


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 32 << 20, path: str | None = None) -> DataFrame:
    """Stores every text as media, reads it back through the data source and describes what was read.

    One row per row of docs: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. A null text counts as empty and is stored as 64 zero samples; a null id stays null; repeated rows are
    stored as often as they come; equal texts give equal values; an empty table gives no rows; other columns are
    ignored. A member that cannot be read after all attempts fails the query rather than being left out.
    """
    path = path or fresh_path(docs.sparkSession, "media")
    store(docs, path, id_col, text_col, archive_bytes)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for member, media, error in zip(batch.column("member").to_pylist(), batch.column("media"), batch.column("error").to_pylist(), strict=True):
                if error:
                    raise OSError(f"{member}: {error}")
                whole = media.as_py()
                length, samples = from_wav(whole)
                doc = int(member[member.index("_") + 1 : -4])
                out.append((doc, length, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["__id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = "__id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = members(docs.sparkSession, path).mapInArrow(describe, schema)
    return rows.select(id_back("__id").alias(id_col), *[c for c in rows.columns if c != "__id"])

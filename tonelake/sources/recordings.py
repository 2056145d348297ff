"""A Spark data source that writes and reads one file a row: recordings and transcripts in ``<speed>wpm`` folders.

``rows.write.format("recordings").option("ext", "wav").mode("append").save(path)`` writes ``recording_id, wpm, content``; ``spark.read.format("recordings")``
reads them back with the file's place. Files are opened with Arrow's file systems (local and shared folders, HDFS, object stores), in tasks only. A task
writes each file under a name of its own and moves it into place, so a task that is run again leaves the same files, and a reader never sees half of one.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.constants import SAMPLE_RATE

SCHEMA = "recording_id string, wpm double, content binary, path string"
#: Files that one task reads.
FILES_A_TASK = 256
#: A file's name is the recording's id; what could leave the folder or clash with Spark's hidden files is not allowed in it.
_NAME = re.compile(r"[^/\\\x00._][^/\\\x00]*")


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str, ext: str) -> list[tuple[str, int]]:
    """Files below a folder with their sizes."""
    from pyarrow import fs

    root, base = _open(path)
    found = root.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(f".{ext}") and not f.base_name.startswith((".", "_")))


def place_of(recording_id: str, wpm: float | None, ext: str) -> str:
    """Folder and name of a recording's file below the root."""
    if not recording_id or not _NAME.fullmatch(recording_id):
        raise ValueError(f"{recording_id!r} is no file name")
    return f"{'' if wpm is None else f'{wpm:g}wpm/'}{recording_id}.{ext}"


class _Written(WriterCommitMessage):
    pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, ext: str, overwrite: bool):
        self.path, self.ext, self.overwrite = path, ext, overwrite
        if overwrite:
            root, at = _open(path)
            root.create_dir(at, recursive=True)
            root.delete_dir_contents(at)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        root, base = _open(self.path)
        made = set()
        for batch in batches:
            for row in batch.select(["recording_id", "wpm", "content"]).to_pylist():
                if row["content"] is None:  # nothing was recorded
                    continue
                to = posixpath.join(base, place_of(row["recording_id"], row["wpm"], self.ext))
                folder = posixpath.dirname(to)
                if folder not in made:
                    root.create_dir(folder, recursive=True)
                    made.add(folder)
                part = posixpath.join(folder, f".{uuid.uuid4().hex}.part")
                with root.open_output_stream(part) as f:
                    f.write(row["content"])
                root.move(part, to)
        return _Written()


class _Files(InputPartition):
    def __init__(self, files: list):
        super().__init__(files)


class _Reader(DataSourceReader):
    def __init__(self, path: str, ext: str):
        self.path, self.ext = path, ext

    def partitions(self) -> list[InputPartition]:
        files = [path for path, _ in _listed(self.path, self.ext)]
        return [_Files(files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        root, _ = _open(self.path)
        for path in partition.value:
            speed = re.search(r"(\d+(?:\.\d+)?)wpm", path)
            with root.open_input_stream(path) as f:
                yield posixpath.basename(path)[: -len(self.ext) - 1], float(speed[1]) if speed else None, f.read(), path


def _wav(f) -> wave.Wave_read | None:
    """The file as WAV, if it is one; anything else is bare samples."""
    head = f.read(4)
    f.seek(0)
    return wave.open(f) if head == b"RIFF" else None


class _Blocks(DataSourceReader):
    """Recordings cut into blocks with what stands before and after each, read by their place in the file: no row and no task holds a whole recording."""

    def __init__(self, path: str, ext: str, block: int, halo: int, at_once: int):
        self.path, self.ext, self.block, self.halo, self.at_once = path, ext, block, halo, at_once

    def partitions(self) -> list[InputPartition]:
        found = []
        for path, size in _listed(self.path, self.ext):
            blocks = max(1, -(-size // (2 * self.block)))  # two bytes a sample at least
            found += [(path, k, min(blocks, k + self.at_once)) for k in range(0, blocks, self.at_once)]
        return [_Files([x]) for x in found] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        root, _ = _open(self.path)
        for path, first, last in partition.value:
            speed = re.search(r"(\d+(?:\.\d+)?)wpm", path)
            with root.open_input_file(path) as f:
                wav = _wav(f)
                if wav is not None and (wav.getframerate() != SAMPLE_RATE or wav.getsampwidth() != 2):
                    raise ValueError(f"{path}: only 16-bit sound at {SAMPLE_RATE} Hz can be read in blocks")
                channels = wav.getnchannels() if wav is not None else 1
                n = wav.getnframes() if wav is not None else f.size() // 2
                for k in range(first, last):
                    start = k * self.block
                    if start >= max(n, 1):
                        break
                    a, b = max(0, start - self.halo), min(n, start + self.block + self.halo)
                    if wav is not None:
                        wav.setpos(a)
                        raw = wav.readframes(b - a)
                    else:
                        f.seek(2 * a)
                        raw = f.read(2 * (b - a))
                    x = (np.frombuffer(raw, "<i2").reshape(-1, channels).mean(1) / 32768).astype(np.float32)
                    audio = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                    own = [posixpath.basename(path)[: -len(self.ext) - 1], float(speed[1]) if speed else None, n, start, start - a, max(0, min(self.block, n - start))]
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(own, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], audio], names=["recording_id", "wpm", "n_samples", "first", "before", "own", "audio"])


class RecordingBlocks(DataSource):
    """Options: ``path``, ``ext``; ``block`` and ``halo`` in samples; ``at_once``: blocks that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "recording_blocks"

    def schema(self) -> str:
        return "recording_id string, wpm double, n_samples long, first long, before int, own int, audio array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        o = self.options
        return _Blocks(o["path"], o.get("ext", "wav"), int(o["block"]), int(o["halo"]), int(o.get("at_once", "64")))


class Recordings(DataSource):
    """Options: ``path`` (what ``load`` and ``save`` are given), ``ext`` (``wav`` without one)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("ext", "wav"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("ext", "wav"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recordings)


def write_files(rows: DataFrame, path: str, ext: str = "wav", replace: bool = False) -> None:
    """One file for each row of ``recording_id, wpm, content``. Rows without content write none; of rows with one id and speed one file stays."""
    register(rows.sparkSession)
    wanted = rows.selectExpr("cast(recording_id as string) recording_id", "cast(wpm as double) wpm", "cast(content as binary) content")
    wanted.write.format("recordings").option("ext", ext).mode("overwrite" if replace else "append").save(path)


def read_files(spark: SparkSession, path: str, ext: str = "wav") -> DataFrame:
    """The files back as rows, a task for each ``FILES_A_TASK`` of them."""
    register(spark)
    return spark.read.format("recordings").option("ext", ext).load(path)


def read_blocks(spark: SparkSession, path: str, block: int, halo: int, ext: str = "wav", at_once: int = 64) -> DataFrame:
    """``recording_id, wpm, n_samples, first, before, own, audio``: ``own`` samples from ``first`` on, with ``before`` samples ahead of them and up to ``halo`` after."""
    spark.dataSource.register(RecordingBlocks)
    return spark.read.format("recording_blocks").options(ext=ext, block=block, halo=halo, at_once=at_once).load(path)

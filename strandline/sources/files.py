"""Image files of a folder, listed by tasks; only marks are read, never whole files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that hold no originals, suffixes by kind, least size and mark of a file without suffix.
SKIPPED = frozenset((".git", "__pycache__", "thumbnails", "lossless", "metadata", "viewer_ready"))
SUFFIXES = {".dcm": "dicom", ".ima": "dicom", ".nii": "nifti", ".nii.gz": "nifti"}
MARKED_BYTES, MARK, MARK_AT = 100_000, b"DICM", 128
#: Folders among which a listing is dealt, at least where there are as many; rows of a batch.
TASKS, ROWS = 64, 4096


def open_store(uri: str):
    """(filesystem, path) of a folder's URI, for any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def image_kind(fs, path: str, size: int) -> str | None:
    """dicom or nifti by suffix (in any case), or dicom by the mark in a large file whose name has no dot; None for others and dot files."""
    name = path.rsplit("/", 1)[-1]
    if name.startswith("."):
        return None
    for suffix, kind in SUFFIXES.items():
        if name.lower().endswith(suffix):
            return kind
    if "." not in name and size > MARKED_BYTES:
        with fs.open_input_file(path) as f:
            return "dicom" if f.read_at(len(MARK), MARK_AT) == MARK else None
    return None


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class ImageReader(DataSourceReader):
    """The driver lists folders only until there are TASKS of them; tasks walk what is below."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.tasks = int(options.get("tasks", TASKS))

    def _entries(self, fs, path: str):
        from pyarrow.fs import FileSelector, FileType

        found = fs.get_file_info(FileSelector(path))
        return [f for f in found if f.type == FileType.File], [f.path for f in found if f.type == FileType.Directory and f.base_name not in SKIPPED]

    def partitions(self) -> list[Folder]:
        fs, path = open_store(self.uri)
        flat, deep = [], [path]
        while deep and len(deep) < self.tasks:
            below = [d for p in deep for d in self._entries(fs, p)[1]]
            flat += deep
            deep = below
        return [Folder(p, False) for p in flat] + [Folder(p, True) for p in deep]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        fs, _ = open_store(self.uri)
        todo, rows = [partition.path], []
        while todo:
            files, folders = self._entries(fs, todo.pop())
            if partition.deep:
                todo += folders
            for f in files:
                if (kind := image_kind(fs, f.path, f.size)) is not None:
                    rows.append((f.path, f.size, kind))
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "length", "kind"])


class ImageFiles(DataSource):
    """Format ``image_files``: options path (folder) and tasks."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "path string, length long, kind string"

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)


def image_files(spark: SparkSession, folder: str, tasks: int = TASKS) -> DataFrame:
    """(path, length, kind) of every image below folder: .dcm and .ima, .nii and .nii.gz, and large files without suffix that have the mark at byte 128.

    Dot files and SKIPPED folders are left out. Of a file at most four bytes are read. A folder that isn't
    there raises; an empty one gives no rows.
    """
    spark.dataSource.register(ImageFiles)
    return spark.read.format("image_files").option("path", folder).option("tasks", tasks).load()

"""Media columns: archives of images, read by a Spark data source that plans byte ranges.

Archives are ZIP files of stored PNG members. The source plans partitions as byte ranges of archives
from the sizes in a manifest alone; a task reads the archive's directory and then the members that start in its
range, each by its own offset and with its own retries, and streams them as Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.llm.inputs import read_spread
from strandline.operators.components import shared_folder

#: Bytes of an archive, of a planned range and of a batch of payloads, about; a larger member is alone.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 8 << 20
#: Ranges at most that one read plans; of larger tables a range has more bytes (a task reads its members one by one, so it needs no more memory).
MOST_RANGES = 65_536
MANIFEST = "manifest"
TRIES = 3
UNIT = 64
_PNG = b"\x89PNG\r\n\x1a\n"


def open_folder(uri: str):
    """(filesystem, path) of a URI as Spark writes it, for any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def pad(data: bytes) -> bytes:
    """With zeros up to the next positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode_image(payload: bytes, n_bytes: int) -> bytes:
    """A PNG of 8-bit grey samples, UNIT wide, that holds the payload losslessly and n_bytes as text."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    parts = ((b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)), (b"tEXt", b"bytes\0%d" % n_bytes), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b""))
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def decode_image(image: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of what encode_image wrote."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, n_bytes = 8, [], 0
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("chunk checksum")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n_bytes = int(body[6:])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, UNIT + 1)[:, 1:].tobytes(), n_bytes


def image_feature(payload: bytes) -> str:
    """Mean, deviation, mean step between neighbours, and a hash of 8 x 8 block means against the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    y = x.astype(np.float64)
    bands = np.array([b.mean(axis=0) if len(b) else y.mean(axis=0) for b in np.array_split(y, 8)]).reshape(8, 8, 8).mean(axis=2)
    bits = np.packbits((bands > y.mean()).ravel()).tobytes().hex()
    return f"{y.mean():.4f};{y.std():.4f};{np.abs(np.diff(x.astype(np.int16), axis=1)).mean():.4f};{bits}"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        held, size, count, done = None, 0, 0, []

        def close() -> None:
            nonlocal held
            out.close()
            done.append((name, held.tell(), count))
            held.close()
            held = None

        for batch in batches:
            for row in range(len(batch)):
                data = (batch.column(1)[row].as_py() or "").encode()
                image = encode_image(pad(data), len(data))
                if held is None:
                    name, size, count = f"{uuid.uuid4().hex}.zip", 0, 0  # of this attempt alone; the manifest names those that count
                    fs.create_dir(path, recursive=True)
                    held = fs.open_output_stream(f"{path}/{name}")
                    out = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                key = batch.column(0)[row].as_py()
                out.writestr(zipfile.ZipInfo(f"{count}/{'' if key is None else key}"), image)
                size, count = size + len(image), count + 1
                if size >= ARCHIVE_BYTES:
                    close()
        if held is not None:
            close()
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "bytes", "members"])

    return run


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each row's text (null: empty) as an image in archives under folder; returns the manifest (archive, bytes, members).

    An archive is streamed to its file. Files of failed attempts stay in the folder, but not in the manifest.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    rows.mapInArrow(_write(folder), "archive string, bytes long, members long").write.parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.parquet(f"{folder}/{MANIFEST}")


class ByteRange(InputPartition):
    def __init__(self, archive: str, low: int, high: int):
        self.archive, self.low, self.high = archive, low, high


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.manifest = options.get("manifest")
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        fs, path = open_folder(self.folder)
        if self.manifest:
            table = pq.read_table(f"{path}/{self.manifest}", columns=["archive", "bytes"], filesystem=fs)
            known = zip(*(table.column(c).to_pylist() for c in ("archive", "bytes")), strict=True)
        else:
            from pyarrow import fs as arrow_fs

            known = [(f.base_name, f.size) for f in fs.get_file_info(arrow_fs.FileSelector(path)) if f.base_name.endswith(".zip")]
        known = sorted(known)
        # an archive has one range at least, so ranges are no more than MOST_RANGES and the archives
        step = max(self.step, -(-sum(size for _, size in known) // MOST_RANGES))
        return [ByteRange(name, low, low + step) for name, size in known for low in range(0, size, step)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        fs, path = open_folder(self.folder)
        file = f"{path}/{partition.archive}"
        with fs.open_input_file(file) as f, zipfile.ZipFile(f) as z:
            members = [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist() if partition.low <= m.header_offset < partition.high]
        rows, held = [], 0
        for offset, name, size, crc in members:
            data, error = read_member(fs, file, offset, size, crc)
            rows.append((partition.archive, offset, name, data, error))
            held += size
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("payload", pa.binary()), ("error", pa.string()))
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def read_member(fs, file: str, offset: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
    """(data, error) of one member; each try opens the file anew and checks the checksum."""
    error = None
    for _ in range(TRIES):
        try:
            with fs.open_input_file(file) as f:
                head = f.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                skip = sum(struct.unpack_from("<HH", head, 26))
                data = f.read_at(size, offset + 30 + skip)
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("member checksum")
            return data, None
        except (OSError, ValueError, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error


class ArchiveSource(DataSource):
    """Format ``media_archive``: options path (folder), manifest (Parquet under it with archive and bytes, else all .zip files count), rangeBytes.

    A reader holds only these, so tasks carry no list of archives.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, member string, payload binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, manifest: str | None = MANIFEST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, offset, member, payload, error) of every member; a member that can't be read has an error and no payload, the others are whole.

    The archives are those of the manifest in folder; with None all ``.zip`` files there.
    """
    spark.dataSource.register(ArchiveSource)
    source = spark.read.format("media_archive").option("path", folder).option("rangeBytes", range_bytes)
    return (source if manifest is None else source.option("manifest", manifest)).load()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for member, image, error in zip(*(batch.column(c).to_pylist() for c in ("member", "payload", "error")), strict=True):
            if error:
                raise OSError(f"{member}: {error}")
            payload, n_bytes = decode_image(image)
            key = member.split("/", 1)[1]
            rows.append((int(key) if key else None, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), image_feature(payload)))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row, computed from what was stored and read back.

    Null and empty texts are 64 zeros. doc_id is an integer or null; repeated rows repeat; an empty
    table gives no rows; other columns are ignored. A member that can't be read after all tries raises,
    as the result would not be whole; ``read_archives`` alone reports it and goes on.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, id_col, text_col)
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_archives(spark, folder).mapInArrow(_describe, kinds)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_spread(spark, f"{sf_dir}/documents.parquet", "doc_id", "text"))

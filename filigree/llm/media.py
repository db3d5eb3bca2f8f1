"""Media columns: payloads stored losslessly as images in archives, and a data source that reads them by range.

Writing: each payload becomes one 8-bit grey image (PNG, rows of 576 samples, written as they are); a task puts its
images into archives (ZIP, members stored) in the shared folder and reports them to a manifest. A task that
runs again writes new archives; only what the manifest names is read.

Reading: the data source ``media_archive`` plans byte ranges over the archives, without reading them. A range opens
its archive once, reads its directory and streams the members that begin inside it as Arrow batches; only for a
member that fails is the file opened again, and the member read by its offset without the others.

A null text is the empty payload, which is padded to one row. A null doc_id stays null; repeated rows are
members of their own. Other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import bounded_batches, shared_dir

ROW, PAD = 576, 255
#: An archive is closed at so many bytes; so is a batch.
ARCHIVE_BYTES, BATCH_BYTES, RANGE_BYTES = 256 << 20, 8 << 20, 16 << 20
ATTEMPTS = 4
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and how many bytes of it are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // ROW)) * ROW
    return raw + bytes([PAD]) * (size - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, own: int, level: int = 1) -> bytes:
    """A grey PNG of the payload; ``own`` goes along as a text chunk."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(grid), ROW + 1), np.uint8)
    lines[:, 1:] = grid
    head = struct.pack(">IIBBBBB", ROW, len(grid), 8, 0, 0, 0, 0)
    note = b"bytes\x00" + str(own).encode()
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", note) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_image(media: bytes) -> tuple[bytes, int]:
    """Payload and own size of an image written by ``to_image``; every checksum is verified."""
    if media[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, parts = 8, {}
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged {kind!r}")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + size
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), int(parts[b"tEXt"].split(b"\x00")[1])


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _write(root: str):
    def run(batches):
        archive = stream = path = None
        members = 0

        def close():
            archive.close()
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([members], pa.int64()), pa.array([size], pa.int64())], ["path", "members", "bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    path, members = f"{root}/{uuid.uuid4().hex}.zip", 0
                    files, own = _files(path)
                    stream = files.open_output_stream(own)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                media = to_image(*payload_of(text))
                archive.writestr(zipfile.ZipInfo(f"{members}_{'null' if doc_id is None else doc_id}.png"), media)
                members += 1
                if stream.tell() >= ARCHIVE_BYTES:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return run


def created(root: str) -> str:
    """The folder, made if its store has folders, as an address that every machine resolves alike."""
    files, own = _files(root)
    files.create_dir(own)
    return f"file://{own}" if files.type_name == "local" else root


def write_archives(docs: DataFrame) -> str:
    """Stores the texts of docs (doc_id, text) in archives; returns the folder of their manifest."""
    bounded_batches(docs.sparkSession)
    root = created(shared_dir(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = shared_dir(docs.sparkSession)
    rows.mapInArrow(_write(root), "path string, members long, bytes long").write.parquet(manifest)
    return manifest


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Range]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector

        files, own = _files(self.manifest)
        names = [f.path for f in files.get_file_info(FileSelector(own)) if f.path.endswith(".parquet")]
        rows = ds.dataset(names, filesystem=files, format="parquet").to_table().to_pylist() if names else []
        return [Range(r["path"], k, min(k + self.size, r["bytes"])) for r in rows for k in range(0, r["bytes"], self.size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, own = _files(part.path)
        names, offsets, media, held = [], [], [], 0
        with files.open_input_file(own) as file:
            members = [m for m in zipfile.ZipFile(file).infolist() if part.start <= m.header_offset < part.end]
            for m in members:
                data = read_member(files, own, m, file)
                names.append(m.filename)
                offsets.append(m.header_offset)
                media.append(data)
                held += len(data)
                if held >= BATCH_BYTES:
                    yield _batch(part.path, names, offsets, media)
                    names, offsets, media, held = [], [], [], 0
        if names:
            yield _batch(part.path, names, offsets, media)


def member_at(file, member: zipfile.ZipInfo) -> bytes:
    """A member's bytes by its offset, verified."""
    file.seek(member.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {member.header_offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(member.header_offset + 30 + name + extra)
    data = file.read(member.compress_size)
    if zlib.crc32(data) != member.CRC:
        raise OSError(f"damaged member at {member.header_offset}")
    return data


def read_member(files, path: str, member: zipfile.ZipInfo, file, attempts: int = ATTEMPTS) -> bytes:
    """A member's bytes by the range's open file; only after a failure the file is opened anew, up to ``attempts`` times in all."""
    try:
        return member_at(file, member)
    except OSError:
        for left in reversed(range(attempts - 1)):
            time.sleep(0.1 * (attempts - left - 1))
            try:
                with files.open_input_file(path) as again:
                    return member_at(again, member)
            except OSError:
                if not left:
                    raise
        raise


def _batch(path, names, offsets, media):
    return pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], ["archive", "name", "offset", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(manifest folder)``: archive, name, offset and media of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, name string, offset long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, manifest: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(manifest)


def feature(payload: bytes) -> str:
    """Which of 64 equal parts of the samples are brighter than their mean, as 16 hex digits, and that mean."""
    samples = np.frombuffer(payload, np.uint8)
    part = samples.reshape(64, -1).mean(1)
    bits = np.packbits(part > samples.mean())
    return f"{bits.tobytes().hex()}:{samples.mean():.3f}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """COLUMNS of each stored member, from its bytes alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload, own = from_image(media)
                doc = name[name.index("_") + 1 : -4]
                digest = lambda b: hashlib.sha256(b).hexdigest()
                rows.append((None if doc == "null" else int(doc), own, len(payload), digest(payload), zlib.crc32(payload[-32:]), len(media), digest(media), feature(payload)))
            fields = [x.split() for x in COLUMNS.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return members.select("name", "media").mapInArrow(run, COLUMNS)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs (doc_id, text), reads the stored bytes back and describes them."""
    return features(read_archives(docs.sparkSession, write_archives(docs)))

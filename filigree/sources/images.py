"""A store of images as a Spark data source: strips of lines in image files, written and read by many tasks.

An image is cut into strips of lines of a bounded size, which tasks write independently, each task one file
of strips after another. A strip is a portable arbitrary map (PAM) of red, green, blue and alpha, whose
comment names its image and first line; cells that an image lacks have alpha 0 and are not read back.

Writing commits in two phases. Tasks write files that no manifest names; when all have ended, the driver
writes one manifest that names them, by a rename, and only what manifests name is read. Files of failed and
repeated attempts are removed at the commit, all of a job's files when it is aborted, so a killed task or job
leaves no part of an image. Overwriting is a manifest that replaces the earlier ones.

Reading plans ranges of whole strips from the manifests alone, and holds one strip at a time.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from filigree.operators.tiles import packed

#: Lines of a strip at most, bytes of a strip (or one line), and about so many bytes to a reading task.
LINES, STRIP_BYTES, RANGE_BYTES = 256, 4 << 20, 16 << 20
#: A cell of a line on its way to the writer.
CELL = np.dtype([("x", "<i4"), ("b", "u1"), ("g", "u1"), ("r", "u1")])
CELLS = "image_id long, y int, x int, b int, g int, r int"
MANIFESTS = "_manifests"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; without a scheme it is this machine's."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    cuts: list[int] = field(default_factory=list)  # where strips start that are RANGE_BYTES apart, and the end
    strips: int = 0


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def header(image: int, y: int, width: int, lines: int) -> bytes:
    return f"P7\n# image {image} line {y}\nWIDTH {width}\nHEIGHT {lines}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".encode()


def parsed(stream) -> tuple[int, int, np.ndarray] | None:
    """The next strip: its image, its first line and its (line, x, red green blue alpha), or None at the end."""
    if not (head := stream.readline()):
        return None
    if head != b"P7\n":
        raise ValueError(f"no strip starts here: {head[:20]!r}")
    known = {}
    while (line := stream.readline()) != b"ENDHDR\n":
        if not line:
            raise ValueError("a strip ends inside its header")
        name, *rest = line.split()
        known[name] = rest
    image, _, y = known[b"#"][1:]
    shape = int(known[b"HEIGHT"][0]), int(known[b"WIDTH"][0]), 4
    data = stream.read(shape[0] * shape[1] * 4)
    if len(data) < shape[0] * shape[1] * 4:
        raise ValueError("a strip ends inside its lines")
    return int(image), int(y), np.frombuffer(data, np.uint8).reshape(shape)


def cells_of(line: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """x of a line's cells, and their values with alpha as one number, whose bytes are red, green, blue and alpha."""
    if pa.types.is_binary(line.type):
        data = np.frombuffer(line.as_buffer(), CELL)
        x, b, g, r = (data[c] for c in CELL.names)
    else:
        x, b, g, r = (line.values.field(c).to_numpy(zero_copy_only=False) for c in CELL.names)
    value = np.uint32(255 << 24)
    for c, shift in ((b, 16), (g, 8), (r, 0)):
        value = value | c.astype("<u4") << np.uint32(shift)
    return x, value


class StripWriter(DataSourceArrowWriter):
    """Gets lines, or parts of lines, (image_id, first, lines, width, y, cells) with a strip's in a row; see ``write_images``.

    Cells are packed (CELL) or structs, sorted; of equal cells of several parts, too, the largest stays.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        done = Written(None)
        stream = strip = key = None

        def close_strip():
            if strip is None:
                return
            if not done.cuts or stream.tell() - done.cuts[-1] >= RANGE_BYTES:
                done.cuts.append(stream.tell())
            image, first = key
            stream.write(header(image, first, strip.shape[1], strip.shape[0]))
            stream.write(strip.tobytes())
            done.strips += 1

        try:
            for batch in iterator:
                columns = [batch.column(c).to_pylist() for c in ("image_id", "first", "lines", "width", "y")]
                for k, (image, first, lines, width, y) in enumerate(zip(*columns, strict=True)):
                    if stream is None:
                        store.create_dir(f"{root}/{self.job}")
                        done.file = f"{self.job}/{uuid.uuid4().hex}.pam"
                        stream = store.open_output_stream(f"{root}/{done.file}")
                    if key != (image, first):
                        close_strip()
                        key, strip = (image, first), np.zeros((lines, width), "<u4")
                    x, value = cells_of(batch.column("cells")[k])
                    line = strip[y - first]
                    line[x] = np.maximum(line[x], value)
            close_strip()
            if stream is not None:
                done.cuts.append(stream.tell())
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
                store.delete_file(f"{root}/{done.file}")
            raise
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        named = [m for m in messages if m is not None and m.file]
        own = [p for p in store.get_file_info(fs.FileSelector(f"{root}/{self.job}", allow_not_found=True))]
        kept = {m.file.rpartition("/")[2] for m in named}
        for info in own:
            if info.base_name not in kept:
                store.delete_file(info.path)
        old = [] if not self.overwrite else [job for job, _ in manifests(store, root)]
        store.create_dir(f"{root}/{MANIFESTS}")
        at = f"{root}/{MANIFESTS}/{self.job}"
        with store.open_output_stream(f"{at}.part") as out:
            out.write(json.dumps({"replaces": old, "files": [[m.file, m.cuts] for m in named]}).encode())
        store.move(f"{at}.part", f"{at}.json")
        for job in old:
            store.delete_file(f"{root}/{MANIFESTS}/{job}.json")
            if store.get_file_info(f"{root}/{job}").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/{job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def manifests(store: fs.FileSystem, root: str) -> list[tuple[str, dict]]:
    """The jobs whose manifests stand, with what they say."""
    found = {}
    for info in store.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                found[info.base_name.removesuffix(".json")] = json.loads(f.read())
    gone = {job for m in found.values() for job in m["replaces"]}
    return [(job, m) for job, m in sorted(found.items()) if job not in gone]


class StripReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        store, root = opened(self.path)
        files = [f for _, m in manifests(store, root) for f in m["files"]]
        return [Range(file, a, b) for file, cuts in files for a, b in zip(cuts, cuts[1:], strict=False)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        store, root = opened(self.path)
        with io.BufferedReader(store.open_input_file(f"{root}/{partition.file}"), 1 << 20) as f:
            f.seek(partition.start)
            while f.tell() < partition.stop:
                image, first, data = parsed(f)
                y, x = np.nonzero(data[..., 3])
                r, g, b = data[y, x, :3].T.astype(np.int32)
                ids = pa.array(np.full(len(y), image), pa.int64())
                columns = [ids, *(pa.array(c.astype(np.int32)) for c in (y + first, x, b, g, r))]
                yield pa.RecordBatch.from_arrays(columns, ["image_id", "y", "x", "b", "g", "r"])


class ImageStore(DataSource):
    """``spark.read.format("filigree_images").load(path)``; written by ``write_images``."""

    @classmethod
    def name(cls) -> str:
        return "filigree_images"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> StripReader:
        return StripReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> StripWriter:
        return StripWriter(self.options["path"], overwrite)


def write_images(image: DataFrame, path: str, mode: str = "append", lines: int = LINES) -> None:
    """Stores images (image_id, y, x, b, g, r), each as many lines and columns as its cells need.

    Rows with a null or negative coordinate or a null id are left out; of several rows of a cell the largest
    stays; channels are held between 0 and 255, and null ones are 0. A line of an image must fit a task.
    """
    image.sparkSession.dataSource.register(ImageStore)
    channel = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(255)).cast("int").alias(c)
    cells = image.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *map(channel, "bgr"))
    cells = cells.filter("image_id is not null and y >= 0 and x >= 0")
    # Sorted by x, then channels, so that the largest of equal cells comes last and is written over the others.
    rows = packed(cells, ["image_id", "y"], CELL)
    sizes = cells.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    each = F.greatest(F.least(F.lit(lines), F.floor(F.lit(STRIP_BYTES) / (4 * F.col("width")))), F.lit(1)).cast("int")
    cut = rows.join(sizes, "image_id").withColumn("each", each).withColumn("strip", F.floor(F.col("y") / F.col("each")).cast("int"))
    cut = cut.withColumn("first", F.col("strip") * F.col("each")).withColumn("lines", F.least("each", F.col("height") - F.col("first")))
    dealt = cut.repartition("image_id", "strip").sortWithinPartitions("image_id", "strip")
    dealt.select("image_id", "first", "lines", "width", "y", "cells").write.format("filigree_images").mode(mode).save(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, b, g, r) of all stored images."""
    spark.dataSource.register(ImageStore)
    return spark.read.format("filigree_images").load(path)

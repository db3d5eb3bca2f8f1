"""The store of images: round trips, two-phase commits, and what failed tasks leave."""

import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.sources import images

COLUMNS = ["image_id", "y", "x", "b", "g", "r"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "image_id long, y int, x int, b int, g int, r int").repartition(5)


def noise(seed, sizes):
    rng = random.Random(seed)
    return [(k, y, x, *(rng.randrange(256) for _ in range(3))) for k, (h, w) in sizes.items() for y in range(h) for x in range(w) if rng.random() < 0.8]


def stored(spark, path):
    return sorted(tuple(r) for r in images.read_stored(spark, path).select(COLUMNS).collect())


def files(path):
    return sorted(f for _, _, names in os.walk(path) for f in names if not f.endswith(".json"))


def test_round_trip_of_several_strips(spark, tmp_path, monkeypatch):
    rows = noise(1, {1: (90, 30), 2: (3, 200), -7: (1, 1), 9: (64, 16)})
    images.write_images(frame(spark, rows), str(tmp_path), lines=16)
    assert stored(spark, str(tmp_path)) == sorted(rows)
    assert stored(spark, f"file://{tmp_path}") == sorted(rows)
    more = noise(2, {3: (5, 5)})
    images.write_images(frame(spark, more), str(tmp_path))
    assert stored(spark, str(tmp_path)) == sorted(rows + more)
    images.write_images(frame(spark, more), str(tmp_path), mode="overwrite")
    assert stored(spark, str(tmp_path)) == sorted(more)
    assert len(os.listdir(tmp_path)) == 2 and len(os.listdir(tmp_path / "_manifests")) == 1


def test_reading_is_planned_by_ranges_of_strips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "RANGE_BYTES", 4096)
    writer = images.StripWriter(str(tmp_path), False)
    cell = lambda x: {"x": x, "b": 1, "g": 2, "r": 3}
    lines = [{"image_id": 1, "first": k, "lines": 1, "width": 300, "y": k, "cells": [cell(k)]} for k in range(20)]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(lines)]))])
    reader = images.StripReader(str(tmp_path))
    parts = reader.partitions()
    assert 5 <= len(parts) <= 20
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(1, k, k, 1, 2, 3) for k in range(20)]


def test_odd_rows(spark, tmp_path):
    rows = [(1, 0, 0, 5, None, 300), (1, 0, 0, 9, 0, -4), (1, None, 0, 1, 1, 1), (None, 0, 0, 1, 1, 1), (1, -1, 0, 1, 1, 1), (2, 7, 3, 0, 0, 0), (2, 7, 3, 0, 0, 0)]
    images.write_images(frame(spark, rows), str(tmp_path))
    assert stored(spark, str(tmp_path)) == [(1, 0, 0, 9, 0, 0), (2, 7, 3, 0, 0, 0)]
    images.write_images(frame(spark, []), str(tmp_path / "none"))
    assert stored(spark, str(tmp_path / "none")) == [] == stored(spark, str(tmp_path / "never"))


def test_cells_are_sent_packed_and_parts_of_a_line_meet(spark, tmp_path):
    rows = noise(5, {1: (3, 40), 2: (2, 9)})
    cells = frame(spark, rows + [(1, 0, 7, 255, 0, 0), (1, 0, 7, 254, 9, 9)])
    lines = images.packed(cells, ["image_id", "y"], images.CELL).collect()
    assert sum(len(line.cells) for line in lines) == 7 * (len(rows) + 2)  # structs of a line took 48 bytes a cell
    assert len(lines) > len({(line.image_id, line.y) for line in lines})
    images.write_images(cells, str(tmp_path))
    want = {r[:3]: r[3:] for r in rows} | {(1, 0, 7): max((255, 0, 0), {r[:3]: r[3:] for r in rows}.get((1, 0, 7), (0, 0, 0)))}
    assert stored(spark, str(tmp_path)) == sorted((*k, *v) for k, v in want.items())


def test_images_of_the_plans_are_made_by_all_tasks(spark):
    from filigree.plans.registry import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    if not os.path.exists(tables.sf_dir):
        pytest.skip("no given tables here")
    for name in ("fx_image", "fx_vessels"):
        assert getattr(tables, name).select(F.spark_partition_id()).distinct().count() == 4


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    before = noise(3, {1: (4, 4)})
    images.write_images(frame(spark, before), str(tmp_path))
    own = files(tmp_path)

    class Broken(images.StripWriter):
        """Fails in the middle of one task's images."""

        def write(self, iterator):
            def some():
                for batch in iterator:
                    yield batch.slice(0, batch.num_rows // 2)
                    if 5 in batch.column("image_id").to_pylist():
                        raise OSError("this task is killed")
                    yield batch.slice(batch.num_rows // 2)

            return super().write(some())

    class BrokenStore(images.ImageStore):
        def writer(self, schema, overwrite):
            return Broken(self.options["path"], overwrite)

    register, images.ImageStore = images.ImageStore, BrokenStore
    try:
        with pytest.raises(Exception, match="this task is killed"):
            images.write_images(frame(spark, noise(4, {k: (8, 8) for k in range(2, 12)})), str(tmp_path), mode="overwrite")
    finally:
        images.ImageStore = register
    assert stored(spark, str(tmp_path)) == sorted(before)
    assert files(tmp_path) == own


def test_files_of_lost_attempts_go_at_the_commit(tmp_path):
    writer = images.StripWriter(str(tmp_path), False)
    line = {"image_id": 1, "first": 0, "lines": 1, "width": 2, "y": 0, "cells": [{"x": 1, "b": 1, "g": 2, "r": 3}]}
    batch = pa.RecordBatch.from_pylist([line])
    writer.write(iter([batch]))  # its message is lost
    message = writer.write(iter([batch]))
    assert images.StripReader(str(tmp_path)).partitions()[0].file == ""  # nothing is read before the commit
    writer.commit([message, None])
    assert files(tmp_path) == [message.file.rpartition("/")[2]]
    (part,) = images.StripReader(str(tmp_path)).partitions()
    assert part.stop == os.path.getsize(tmp_path / message.file)


def test_cut_off_strips_are_errors(tmp_path):
    whole = images.header(3, 0, 2, 1) + bytes(8)
    for end in (1, 10, len(whole) - 1):
        with pytest.raises(ValueError), io.BytesIO(whole[:end]) as f:
            images.parsed(f)
    image, y, data = images.parsed(io.BytesIO(whole))
    assert (image, y, data.shape) == (3, 0, (1, 2, 4)) and not np.any(data)


def test_one_large_image_is_many_tasks(spark, tmp_path):
    big = spark.range(600).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(199))))
    big = big.select("image_id", "y", "x", *[F.pmod(F.xxhash64("y", "x", F.lit(c)), F.lit(256)).cast("int").alias(c) for c in "bgr"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little goes to one task
    try:
        images.write_images(big, str(tmp_path), lines=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files(tmp_path)) > 1
    assert images.read_stored(spark, str(tmp_path)).exceptAll(big).isEmpty() and images.read_stored(spark, str(tmp_path)).count() == big.count()

"""TIFF rasters: bytes of other writers' layouts, pruning, refusals, and the way to a surface."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield import cli
from tetrafield.operators import tiles
from tetrafield.plans import construction
from tetrafield.queries import QUERIES, SQL
from tetrafield.sinks import tiff as sink
from tetrafield.sources import tiff

KIND = {np.dtype("u2"): (3, 1), np.dtype("i4"): (4, 2), np.dtype("f4"): (4, 3), np.dtype("f8"): (4, 3)}


def stripped(path, values, order="<", rows=3, deflate=False, predictor=1, apart=False, big=False, tags=()):
    """A file in strips, written plainly: values (row, column, band)."""
    h, w, bands = values.shape
    kind = values.dtype.newbyteorder(order)
    planes = [values[:, :, b : b + 1] for b in range(bands)] if apart else [values]
    strips = []
    for plane in planes:
        for a in range(0, h, rows):
            own = plane[a : a + rows]
            if predictor == 2:
                own = np.concatenate([own[:, :1], np.diff(own, axis=1)], axis=1)
                raw = own.astype(kind).tobytes()
            elif predictor == 3:
                n, s = values.dtype.itemsize, own.shape[2]
                planes_of = own.astype(f">f{n}").reshape(len(own), w * s).view("u1").reshape(len(own), w * s, n).transpose(0, 2, 1).reshape(len(own), -1, s)
                raw = np.concatenate([planes_of[:, :1], np.diff(planes_of, axis=1)], axis=1).astype("u1").tobytes()
            else:
                raw = own.astype(kind).tobytes()
            strips.append(zlib.compress(raw) if deflate else raw)
    head, wide, inline = (16, 20, 8) if big else (8, 12, 4)
    offsets, at = [], head
    for s in strips:
        offsets.append(at)
        at += len(s)
    own = [
        (256, 3, [w]), (257, 3, [h]), (258, 3, [values.dtype.itemsize * 8] * bands), (259, 3, [8 if deflate else 1]), (273, 4, offsets), (277, 3, [bands]),
        (278, 3, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if apart else 1]), (317, 3, [predictor]), (339, 3, [KIND[values.dtype][1]] * bands), *tags,
    ]
    rest, entries = b"", b""
    after = at + (8 if big else 2) + wide * len(own) + inline
    for tag, code, v in sorted(own):
        raw = v if isinstance(v, bytes) else np.asarray(v).astype(order + tiff.KINDS[code]).tobytes()
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(v))
        entries += raw.ljust(inline, b"\0") if len(raw) <= inline else struct.pack(order + ("Q" if big else "I"), after + len(rest))
        rest += raw if len(raw) > inline else b""
    mark = b"II" if order == "<" else b"MM"
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    with open(path, "wb") as f:
        f.write(start + b"".join(strips) + struct.pack(order + ("Q" if big else "H"), len(own)) + entries + b"\0" * inline + rest)
    return str(path)


def back(rows, bands, shape):
    made = np.full((*shape, bands), np.nan)
    for r in rows.collect():
        made[r.iy, r.ix] = [np.nan if v is None else v for v in r[2:]]
    return made


@pytest.mark.parametrize("name", ["tiff_window", "tiff_surface"])
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name])


@pytest.mark.parametrize(
    "dtype, options",
    [
        ("f4", {}), ("f4", {"order": ">", "big": True}), ("u2", {"deflate": True, "predictor": 2}), ("i4", {"order": ">", "predictor": 2, "deflate": True}),
        ("f4", {"deflate": True, "predictor": 3}), ("f8", {"order": ">", "deflate": True, "predictor": 3, "apart": True}), ("f4", {"apart": True}),
        ("f8", {"rows": 7, "order": ">"}),
    ],
)
def test_layouts(spark, tmp_path, monkeypatch, dtype, options):
    values = np.random.default_rng(5).integers(0, 2000, (7, 5, 2)).astype(dtype)
    path = stripped(tmp_path / "a.tif", values, **options)
    monkeypatch.setattr(tiff, "PART_BYTES", 2 * 5 * values.dtype.itemsize)  # long strips are read in pieces, every block is a part
    assert (back(tiff.read(spark, path, [1, 2]), 2, (7, 5)) == values).all()
    got = back(tiff.read(spark, f"file://{path}", [2]).filter("ix > 1 AND ix <= 3 AND iy >= 2.5 AND iy < 5.5"), 1, (7, 5))
    assert (got[3:6, 2:4, 0] == values[3:6, 2:4, 1]).all() and np.isfinite(got).sum() == 6
    assert tiff.read(spark, path).filter("iy = 4").count() == 5
    assert tiff.read(spark, path).filter("iy = 40 OR ix < 0").isEmpty() and tiff.read(spark, path).filter("ix < 0").isEmpty()


def test_blocks_that_are_not_asked_for_are_not_read(spark, tmp_path):
    nodes = spark.range(64 * 48).select((F.col("id") % 64).alias("ix"), F.floor(F.col("id") / 64).alias("iy"), F.col("id").cast("double").alias("z"))
    path = f"{tmp_path}/t.tif"
    sink.write(nodes, path, (64, 48), compress=False, tile=16)
    raster = tiff.about(path)
    f = os.open(path, os.O_RDWR)
    at = int(raster.counts.at)  # lengths of tiles beyond the first row and column are spoilt: reading one fails
    for n in set(range(12)) - {5}:
        os.pwrite(f, np.int32(3).tobytes(), at + 4 * n)
    os.close(f)
    inside = tiff.read(spark, path).filter("ix >= 16 AND ix <= 31 AND iy > 15 AND iy < 32")
    assert inside.agg(F.count("b1"), F.sum(F.abs(F.col("b1") - F.col("iy") * 64 - F.col("ix")))).first() == (256, 0.0)
    with pytest.raises(Exception, match="a block holds"):
        tiff.read(spark, path).filter("ix >= 15 AND ix <= 31 AND iy > 15 AND iy < 32").collect()


def test_no_data_and_place(spark, tmp_path):
    values = np.arange(12, dtype="i4").reshape(3, 4, 1)
    scale, tie = (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [1.0, 1.0, 0.0, 100.0, 50.0, 0.0])
    path = stripped(tmp_path / "a.tif", values, tags=(scale, tie, (42113, 2, b"5\0")))
    assert [r.b1 for r in tiff.read(spark, path).filter("iy = 1").orderBy("ix").collect()] == [4, None, 6, 7]
    raster = tiff.about(path)
    assert raster.to_world == ((2.0, 0.0, 99.0), (0.0, -3.0, 51.5)) and raster.no_data == 5 and raster.epsg is None


def test_writing(spark, tmp_path):
    some = spark.createDataFrame([(0, 0, 1.5), (39, 2, float("nan")), (20, 33, 7.0), (21, 33, None)], "ix int, iy int, z double")
    sink.write(some, f"{tmp_path}/t.tif", (40, 34), to_world=((1, 0, 5), (0, -1, 9)), epsg=32760, tile=16)
    raster = tiff.about(f"{tmp_path}/t.tif")
    assert (raster.shape, raster.epsg, raster.to_world) == ((40, 34), 32760, ((1.0, 0.0, 5.0), (0.0, -1.0, 9.0)))
    rows = tiff.read(spark, f"{tmp_path}/t.tif")
    assert rows.count() == 40 * 34
    assert {tuple(r) for r in rows.filter("b1 IS NOT NULL").collect()} == {(0, 0, 1.5), (20, 33, 7.0)}
    for wrong in (some.union(some), some.withColumn("ix", F.col("ix") + 1)):
        with pytest.raises(Exception, match="same place|outside the raster"):
            sink.write(wrong, f"{tmp_path}/bad.tif", (40, 34), tile=16)
    assert os.listdir(tmp_path) == ["t.tif"]
    sink.write(some.limit(0), f"{tmp_path}/none.tif", (40, 34), tile=16)
    assert tiff.read(spark, f"{tmp_path}/none.tif").filter("b1 IS NULL").count() == 40 * 34


def test_refusals(spark, tmp_path):
    values = np.zeros((2, 2, 1), "f4")
    (tmp_path / "no.tif").write_bytes(b"text, and some more of it")
    with pytest.raises(ValueError, match="isn't a TIFF"):
        tiff.about(f"{tmp_path}/no.tif")
    path = stripped(tmp_path / "a.tif", values)
    with pytest.raises(ValueError, match="bands 1 to 1"):
        tiff.read(spark, path, [2])
    raw = bytearray((tmp_path / "a.tif").read_bytes())
    at = raw.index(struct.pack("<HHI", 259, 3, 1))
    raw[at + 8] = 5
    (tmp_path / "lzw.tif").write_bytes(raw)
    with pytest.raises(ValueError, match="compression 5"):
        tiff.about(f"{tmp_path}/lzw.tif")
    with pytest.raises(ValueError, match="mount"):
        tiff.about("s3://bucket/a.tif")


def test_convert(spark, tmp_path):
    values = np.full((9, 8, 1), -9999.0, "f4")
    values[2:7, 1:6, 0] = np.arange(25).reshape(5, 5)
    values[4, 3] = -9999
    tags = ((33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 1000.0, 2000.0, 0.0]), (42113, 2, b"-9999\0"))
    path = stripped(tmp_path / "a.tif", values, tags=tags)
    assert cli.main(["convert-tiff", path, "1", f"{tmp_path}/a.surface", "--downsample", "2", "--flip"]) == 0
    own = tiles.read(spark, f"{tmp_path}/a.surface")
    assert own.shape == (2, 2)
    got = {(r.ix, r.iy): (r.x, r.y, r.z) for r in own.window().collect()}
    assert got[0, 0] == pytest.approx((1020.0, 1970.0, -3.0)) and got[1, 1] == pytest.approx((1040.0, 1950.0, -(13 + 17 + 18) / 3))
    place = spark.createDataFrame([(1030.0, 1970.0)], "x double, y double")
    assert own.sample(place).first().surface == pytest.approx(-4.0)
    none = stripped(tmp_path / "none.tif", np.full((3, 3, 1), np.nan, "f4"))
    with pytest.raises(ValueError, match="no valid pixel"):
        construction.convert_tiff(spark, none, f"{tmp_path}/none.surface")

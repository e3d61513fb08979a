"""Chunked arrays: the layout, pruning, and nothing left by a job that fails."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.queries import QUERIES, SQL
from tetrafield.sinks import arrays, formats


def model(spark, ni=5, nj=4, nk=3, grid="a"):
    n = F.col("id")
    own = spark.range(ni * nj * nk).select(F.lit(grid).alias("grid"), F.floor(n / (nj * nk)).alias("i"), (F.floor(n / nk) % nj).alias("j"), (n % nk).alias("k"))
    return own.withColumns({v: F.col("i") * 100.0 + F.col("j") * 10 + F.col("k") + c * 1000 for c, v in enumerate(arrays.VARIABLES)})


def test_query(spark):
    assert_same(QUERIES["zarr_round_trip"](spark, SF), SQL["zarr_round_trip"])


def test_layout(spark, tmp_path):
    both = model(spark).unionByName(model(spark, 2, 2, 2, "b"))
    formats.write(both.repartition(3), f"{tmp_path}/m.zarr")
    arrays.write(both, f"file://{tmp_path}/m.zarr", chunk=(2, 3, 3), attributes={"title": "t"})  # in place of the first
    assert os.listdir(tmp_path) == ["m.zarr"]
    told = json.loads((tmp_path / "m.zarr/a/vp/zarr.json").read_text())
    assert told["shape"] == [5, 4, 3] and told["chunk_grid"]["configuration"]["chunk_shape"] == [2, 3, 3]
    assert json.loads((tmp_path / "m.zarr/zarr.json").read_text())["attributes"] == {"title": "t"}
    chunk = np.frombuffer(gzip.decompress((tmp_path / "m.zarr/a/x/c/1/1/0").read_bytes()), "<f4").reshape(2, 3, 3)
    i, k = np.meshgrid(np.arange(2, 4), np.arange(3), indexing="ij")
    assert (chunk[:, 0] == i * 100 + 30 + k).all() and np.isnan(chunk[:, 1:]).all()
    rows = arrays.read(spark, f"{tmp_path}/m.zarr")
    assert rows.exceptAll(both.select(rows.columns)).isEmpty() and rows.count() == 68


def test_pruning_and_missing_nodes(spark, tmp_path):
    arrays.write(model(spark).filter("i < 2 OR i = 4"), f"{tmp_path}/m.zarr", chunk=(1, 2, 3))
    assert not (tmp_path / "m.zarr/a/x/c/2").exists()
    assert arrays.read(spark, f"{tmp_path}/m.zarr").filter("x IS NULL").count() == 2 * 12
    for chunk in ("0/0/0", "1/0/0", "4/1/0"):
        (tmp_path / f"m.zarr/a/x/c/{chunk}").write_bytes(b"spoilt")
    rows = arrays.read(spark, f"{tmp_path}/m.zarr", ["x"])
    assert rows.filter("grid = 'a' AND i >= 1 AND i <= 2 AND j > 1").agg(F.count("x"), F.count(F.lit(1))).first() == (6, 12)
    assert rows.filter("grid = 'b'").isEmpty() and rows.filter("i > 9").isEmpty()
    with pytest.raises(Exception, match="[gG]zip"):
        rows.filter("i >= 1 AND i <= 2").collect()


def test_refusals_leave_nothing(spark, tmp_path):
    own = model(spark)
    with pytest.raises(Exception, match="same place"):
        arrays.write(own.union(own.filter("i = 1 AND j = 1")), f"{tmp_path}/m.zarr")
    for wrong in (own.withColumn("station", F.lit("s")), own.withColumn("i", F.col("i") - 1), own.withColumn("grid", F.lit("a/b")), own.withColumn("grid", F.when(F.col("i") > 0, "a"))):
        with pytest.raises(ValueError):
            arrays.write(wrong, f"{tmp_path}/m.zarr")
    assert os.listdir(tmp_path) == []
    arrays.write(own.limit(0), f"{tmp_path}/none.zarr")
    assert arrays.read(spark, f"{tmp_path}/none.zarr").isEmpty()
    with pytest.raises(ValueError, match="holds no arrays"):
        arrays.store(str(tmp_path))

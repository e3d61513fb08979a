"""The solver's files: bytes, and nothing left by a job that fails."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.queries import QUERIES, SQL
from tetrafield.sinks import binary, formats


def block(spark, ni=3, nj=4, nk=2):
    own = spark.range(ni * nj * nk).select(F.lit("a").alias("grid"), (F.col("id") % ni).alias("i"), (F.floor(F.col("id") / ni) % nj).alias("j"), F.floor(F.col("id") / (ni * nj)).alias("k"))
    return own.withColumns({"rho": F.col("i") * 1000.0, "vp": F.col("j") * 1000.0, "vs": F.col("k") * 1000.0})


def test_query(spark):
    assert_same(QUERIES["emod3d_bytes"](spark, SF), SQL["emod3d_bytes"])


def test_layout(spark, tmp_path):
    formats.write(block(spark).repartition(5), f"{tmp_path}/out", "emod3d")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(binary.FILES.values())
    j, k, i = np.meshgrid(np.arange(4.0)[::-1], np.arange(2.0), np.arange(3.0), indexing="ij")
    for name, want in (("rho3dfile.d", i), ("vp3dfile.p", j), ("vs3dfile.s", k)):
        assert (np.fromfile(tmp_path / "out" / name, "<f4").reshape(4, 2, 3) == want).all()
    assert binary.read(spark, f"file://{tmp_path}/out", (3, 4, 2)).filter("rho <> i OR vp <> j OR vs <> k").isEmpty()


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    twice = block(spark).withColumn("i", F.when((F.col("i") == 1) & (F.col("j") == 1) & (F.col("k") == 0), 2).otherwise(F.col("i")))
    with pytest.raises(Exception, match="same place"):
        binary.write(twice, f"{tmp_path}/bad")
    assert os.listdir(tmp_path / "bad") == []
    with pytest.raises(ValueError):
        binary.write(block(spark).filter("i <> 1 OR j <> 1"), f"{tmp_path}/lacking")
    with pytest.raises(ValueError):
        binary.local("s3://bucket/x")

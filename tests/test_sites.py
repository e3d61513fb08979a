"""Site batches that are taken up again."""

import pytest
from pyspark.sql import functions as F

from tests.compare import SF, assert_same
from tetrafield.operators import sites
from tetrafield.queries import QUERIES, SQL


def test_query(spark):
    assert_same(QUERIES["site_resume"](spark, SF), SQL["site_resume"])


def test_a_rerun_neither_doubles_nor_loses(spark, tmp_path):
    stations = spark.range(40).select(F.col("id").alias("station"))
    asked = []

    def profile(some, depth):
        asked.append(sorted(r.station for r in some.collect()))
        rows = some.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(int(depth // 10)))))
        return rows.select("station", (F.col("k") * 10.0).alias("depth"), F.when(F.col("station") % 7 == 0, 100.0).otherwise(F.col("k") * 1000.0).alias("vs"))

    own = sites.Batches(spark, str(tmp_path / "db"), 6)
    assert own.pending(stations) == sorted({r.batch for r in own.of(stations).collect()})

    def breaks_off(written):
        if own.finished().count() == 2:
            raise InterruptedError

    with pytest.raises(InterruptedError):
        own.run(stations, profile, 20.0, 40.0, at_once=2, before_marking=breaks_off)
    half = own.finished().count()
    marked = {r.station for r in own.profiles().select("station").distinct().collect()}
    assert half == 2 and 0 < len(marked) < 40
    asked.clear()
    assert len(own.run(stations, profile, 20.0, 40.0, at_once=2)) == len(own.of(stations).select("batch").distinct().collect()) - half
    assert not {s for some in asked for s in some} & marked  # what was finished isn't asked again
    counts = {r.station: r["count"] for r in own.profiles().groupBy("station").count().collect()}
    assert set(counts) == set(range(40)) and all(counts[n] == 5 for n in range(0, 40, 7)) and sum(counts.values()) == own.profiles().distinct().count()
    assert {r.station for r in spark.read.parquet(str(tmp_path / "db" / "unreached")).collect()} == {n for n in range(40) if n % 7 == 0}
    assert own.run(stations, profile, 20.0, 40.0) == []
    with pytest.raises(ValueError):
        own.run(stations.union(stations), profile, 20.0, 40.0)

"""Products: site summaries, deepening, sections."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grids, sites
from ..sinks import formats
from . import chains, world

QUERIES, SQL = {}, {}


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as profiles: a station for each user, a sample every 5 m in order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1
    return e.select(F.col("user_id").alias("station"), (k * 5.0).alias("depth"), (200 + 10 * F.col("value")).alias("vs"))


def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.summarise(profiles(spark, sf_dir)).select("station", F.round("vs30", 6).alias("vs30"), "z1p0", "z2p5", "profile_depth")


SQL_PROFILES = "p AS (SELECT user_id AS station, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) * 5.0::DOUBLE AS depth, 200 + 10 * value AS vs FROM events)"
QUERIES["site_summary"] = site_summary
SQL["site_summary"] = f"""WITH {SQL_PROFILES}, d AS (SELECT *, least(lead(depth) OVER (PARTITION BY station ORDER BY depth), 30) - least(depth, 30) AS dz FROM p)
SELECT station, round(30 / sum(dz / vs), 6) AS vs30, min(depth) FILTER (vs >= 1000) AS z1p0, min(depth) FILTER (vs >= 2500) AS z2p5, max(depth) AS profile_depth FROM d GROUP BY station"""


def site_vs30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_summary(spark, sf_dir).select("station", "vs30")


QUERIES["site_vs30"] = site_vs30
SQL["site_vs30"] = f"SELECT station, vs30 FROM ({SQL['site_summary']})"


def site_z1p0_z2p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_summary(spark, sf_dir).select("station", "z1p0", "z2p5")


QUERIES["site_z1p0_z2p5"] = site_z1p0_z2p5
SQL["site_z1p0_z2p5"] = f"SELECT station, z1p0, z2p5 FROM ({SQL['site_summary']})"


def site_deepening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' profiles, 2 m/s faster with each metre and with their number: deepened until 2500 m/s or 800 m."""
    stations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("station"))

    def profile(some: DataFrame, depth: float) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(int(depth // 50))))
        return some.withColumn("k", k).select("station", (F.col("k") * 50.0).alias("depth"), (500.0 + F.col("station") % 40 * 50 + 2 * F.col("k") * 50).alias("vs"))

    done, _ = sites.deepen(stations, profile, 100.0, 800.0)
    return sites.summarise(done).select("station", "z1p0", "z2p5", "profile_depth")


QUERIES["site_deepening"] = site_deepening
SQL["site_deepening"] = """WITH s AS (SELECT s_suppkey AS station, 500.0::DOUBLE + s_suppkey % 40 * 50 AS v0 FROM supplier),
d AS (SELECT *, CASE WHEN v0 + 200 >= 2500 THEN 100 WHEN v0 + 400 >= 2500 THEN 200 WHEN v0 + 800 >= 2500 THEN 400 ELSE 800 END AS deep FROM s),
p AS (SELECT station, k * 50.0::DOUBLE AS depth, v0 + 100 * k AS vs FROM d, generate_series(0, 16) g(k) WHERE k * 50 <= deep)
SELECT station, min(depth) FILTER (vs >= 1000) AS z1p0, min(depth) FILTER (vs >= 2500) AS z2p5, max(depth) AS profile_depth FROM p GROUP BY station"""


def site_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same suppliers in batches; the first run breaks off with two batches written but not marked, the second finishes."""
    stations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("station"))

    def profile(some: DataFrame, depth: float) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(int(depth // 50))))
        return some.withColumn("k", k).select("station", (F.col("k") * 50.0).alias("depth"), (500.0 + F.col("station") % 40 * 50 + 2 * F.col("k") * 50).alias("vs"))

    database = sites.Batches(spark, formats.scratch(spark, "sites"), 5)

    def breaks_off(written: list[int]) -> None:
        if database.finished().count():
            raise InterruptedError(f"batches {written} are written and not marked")

    with contextlib.suppress(InterruptedError):
        database.run(stations, profile, 100.0, 800.0, at_once=2, before_marking=breaks_off)
    database.run(stations, profile, 100.0, 800.0, at_once=2)
    return sites.summarise(database.profiles()).select("station", "z1p0", "z2p5", "profile_depth")


QUERIES["site_resume"] = site_resume
SQL["site_resume"] = SQL["site_deepening"]


def fence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section across the sampled grid, from corner to corner, bilinear between columns."""
    values = chains.sampled(chains.lattice(spark), world.index(spark)).select("i", "j", "k", "vs", "rho")
    along = spark.range(33).select(F.col("id").alias("s"), (F.col("id") * 14 / 32).alias("fi"), (F.col("id") * 7 / 32 + 3).alias("fj"))
    made = grids.fence(values, along, ["vs", "rho"], (15, 15))
    return made.select("s", "k", F.round("vs", 5).alias("vs"), F.round("rho", 5).alias("rho"))


QUERIES["fence_sample"] = fence_sample
SQL["fence_sample"] = f"""WITH v AS ({chains.SQL_SAMPLED}), a AS (SELECT s, s * 14 / 32.0::DOUBLE AS fi, s * 7 / 32.0::DOUBLE + 3 AS fj FROM generate_series(0, 32) g(s)),
b AS (SELECT *, least(floor(fi), 13)::BIGINT AS ia, least(floor(fj), 13)::BIGINT AS ja FROM a),
c AS (SELECT s, ia + di AS i, ja + dj AS j, CASE WHEN di = 1 THEN fi - ia ELSE 1 - (fi - ia) END * CASE WHEN dj = 1 THEN fj - ja ELSE 1 - (fj - ja) END AS w FROM b, generate_series(0, 1) x(di), generate_series(0, 1) y(dj))
SELECT s, k, round(sum(w * vs), 5) AS vs, round(sum(w * rho), 5) AS rho FROM c JOIN v USING (i, j) WHERE w <> 0 GROUP BY s, k"""


def station_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with names of a given length, each once, and their order."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("station"), F.col("n_nationkey").alias("ordinal"))
    return sites.named(sites.unique(n), (8, 9))


QUERIES["station_list"] = station_list
SQL["station_list"] = "SELECT n_name AS station, n_nationkey AS ordinal FROM nation WHERE length(n_name) IN (8, 9)"

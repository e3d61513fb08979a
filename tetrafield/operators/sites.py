"""Products by site: velocities and depths from profiles, and deepening until every profile is deep enough."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHALLOW = 30.0
VS_1P0, VS_2P5 = 1000.0, 2500.0


def summarise(profiles: DataFrame, site: str = "station") -> DataFrame:
    """(site, vs30, z1p0, z2p5, profile_depth) of profiles (site, depth, vs, ...).

    Each sample stands for the interval to the next, cut off at 30 m. A depth is that of the first sample as fast as asked, or NULL.
    """
    order = Window.partitionBy(site).orderBy("depth")
    upto = F.least("depth", F.lit(SHALLOW))
    rows = profiles.withColumn("_dz", F.least(F.lead("depth").over(order), F.lit(SHALLOW)) - upto)
    time = F.try_divide(F.sum(F.try_divide("_dz", "vs")), F.lit(1.0))
    return rows.groupBy(site).agg(
        F.try_divide(F.lit(SHALLOW), time).alias("vs30"), F.min(F.when(F.col("vs") >= VS_1P0, F.col("depth"))).alias("z1p0"),
        F.min(F.when(F.col("vs") >= VS_2P5, F.col("depth"))).alias("z2p5"), F.max("depth").alias("profile_depth"),
    )


def deepen(sites: DataFrame, profile: Callable[[DataFrame, float], DataFrame], start: float, limit: float, target: float = VS_2P5, site: str = "station") -> tuple[DataFrame, DataFrame]:
    """(profiles, sites that never reach the target): depth doubles for those that haven't reached it, up to a limit.

    `profile` gives (site, depth, vs, ...) down to a depth. A pass only asks for what the last ones left.
    """
    pending, depth, done = sites, float(start), None
    while True:
        made = profile(pending, depth).persist()
        reached = made.groupBy(site).agg(F.max("vs").alias("_v")).filter(F.col("_v") >= target).select(site)
        last = depth >= limit
        ready = made if last else made.join(reached, site, "left_semi")
        done = ready if done is None else done.unionByName(ready)
        pending = pending.join(reached, site, "left_anti").persist()
        if last or pending.isEmpty():
            return done, pending
        depth = min(2 * depth, limit)


def unique(stations: DataFrame, site: str = "station") -> DataFrame:
    """The stations as they are; raises where one is doubled."""
    twice = repeated(stations, site).select(site).limit(5).collect()
    if twice:
        raise ValueError(f"stations occur more than once: {sorted(str(r[0]) for r in twice)}")
    return stations


def named(stations: DataFrame, lengths: Sequence[int] = (3, 4), site: str = "station") -> DataFrame:
    return stations.filter(F.length(site).isin(*lengths))


def repeated(stations: DataFrame, site: str = "station") -> DataFrame:
    """(site, n) of those that occur more than once."""
    return stations.groupBy(site).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first(stations: DataFrame, n: int, ordinal: str = "ordinal", site: str = "station") -> DataFrame:
    """The first n stations by their ordinal, ties by name."""
    return stations.orderBy(ordinal, site).limit(n)


def in_order(rows: DataFrame, stations: DataFrame, site: str = "station", ordinal: str = "ordinal") -> DataFrame:
    """rows in the order of the stations' ordinals."""
    return rows.join(stations.select(site, ordinal), site).orderBy(ordinal)


@dataclass
class Batches:
    """A site database that is written batch by batch and taken up again after a break.

    A site's batch is a hash of its name. `profiles` and `unreached` are partitioned by batch, and writing a batch replaces its
    partition; `finished` lists a batch once both are written. A rerun leaves finished batches out and writes the others anew, so what
    a break left behind neither stays beside the new rows nor is lost.
    """

    spark: SparkSession
    path: str
    number: int = 16
    site: str = "station"

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("batch", F.pmod(F.xxhash64(self.site), F.lit(self.number)).cast("int"))

    def finished(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch int").parquet(f"{self.path}/finished").distinct()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], "batch int")

    def pending(self, stations: DataFrame) -> list[int]:
        """Batches of the stations that aren't finished: at most `number`."""
        return sorted(r["batch"] for r in self.of(stations).select("batch").distinct().join(self.finished(), "batch", "left_anti").collect())

    def run(self, stations: DataFrame, profile: Callable[[DataFrame, float], DataFrame], start: float, limit: float, target: float = VS_2P5, at_once: int = 4, before_marking: Callable[[list[int]], None] | None = None) -> list[int]:
        """Deepens the stations of all pending batches, `at_once` batches in one job; returns the batches done. before_marking is told what is written and not yet marked."""
        own, left = self.of(unique(stations, self.site)), self.pending(stations)
        for n in range(0, len(left), at_once):
            some = left[n : n + at_once]
            done, never = deepen(own.filter(F.col("batch").isin(some)).drop("batch"), profile, start, limit, target, self.site)
            self._replace(done, "profiles")
            self._replace(never, "unreached")
            if before_marking is not None:
                before_marking(some)
            self.spark.createDataFrame([(b,) for b in some], "batch int").coalesce(1).write.mode("append").parquet(f"{self.path}/finished")
        return left

    def _replace(self, rows: DataFrame, name: str) -> None:
        out = self.of(rows).repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("batch").parquet(f"{self.path}/{name}")

    def profiles(self) -> DataFrame:
        """Rows of finished batches only."""
        return self.spark.read.parquet(f"{self.path}/profiles").join(self.finished(), "batch", "left_semi").drop("batch")

"""Headline queries on $BENCH_SF_DIR; prints one line of JSON. Each query runs once to warm up and then counts."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tetrafield.queries import QUERIES, world  # noqa: E402

HEADLINE = ["query_many", "composite_basins", "locate_points", "explain_hits", "bilinear_clamp", "coast_signed", "grid_sw4", "layer_ely", "layer_backus", "site_summary"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took = {}
    for name in HEADLINE:
        run(name)
        took[name] = round(run(name), 3)
    points = world.lineitem_points(spark, sf).count()
    print(json.dumps({"metric": "seconds for the headline queries, warm session", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1].strip("/"), "cores": int(cpus), "points": points, "points_per_sec_query_many": round(points / took["query_many"])}))
    spark.stop()


if __name__ == "__main__":
    main()

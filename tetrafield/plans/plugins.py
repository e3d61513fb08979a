"""What is registered, and what installed packages add through entry points."""

from __future__ import annotations

from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

from ..sinks import formats
from . import config

GROUPS = ("tetrafield.grids", "tetrafield.layers", "tetrafield.formats", "tetrafield.sources", "tetrafield.queries")
failures: dict[str, str] = {}


def discover() -> list[str]:
    """Loads entry points of all groups; one that fails is noted in `failures` and doesn't stop the others."""
    loaded = []
    for group in GROUPS:
        for point in entry_points(group=group):
            try:
                point.load()
                loaded.append(f"{group}:{point.name}")
            except Exception as e:  # noqa: BLE001
                failures[f"{group}:{point.name}"] = repr(e)
    return loaded


def listing(spark: SparkSession) -> DataFrame:
    """(kind, name, detail) of all that is registered."""
    rows = [("grid", n, ", ".join(sorted(r))) for n, (r, _) in config.GRIDS.items()] + [("layer", n, ", ".join(sorted(r))) for n, (r, _) in config.LAYERS.items()]
    rows += [("format", f.name, ", ".join(f.extensions)) for f in formats.formats().values()] + [("failure", k, v) for k, v in failures.items()]
    return spark.createDataFrame(rows, "kind string, name string, detail string")

"""Output formats by name and suffix, and the writers of sampled models.

A model is rows: grid, labels, i, j, k, x, y, z, depth, nominal_depth and the six components. Values are single precision on disk.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import footprints, grids
from ..schema import COMPONENTS
from . import arrays, binary

PLACE = ("i", "j", "k", "x", "y", "z", "depth", "nominal_depth")
QUANTUM = 0.5  # of coordinates, where values are quantised: an error of a quarter at most


@dataclass(frozen=True)
class Format:
    name: str
    extensions: tuple[str, ...]
    write: Callable[..., None]
    quantises: bool = False


_FORMATS: dict[str, Format] = {}


def register(name: str, extensions: tuple[str, ...] = (), quantises: bool = False) -> Callable:
    def add(write: Callable[[DataFrame, str], None]) -> Callable[[DataFrame, str], None]:
        taken = {e for f in _FORMATS.values() for e in f.extensions} & set(extensions)
        if name in _FORMATS or taken:
            raise ValueError(f"format {name!r} or its extensions {sorted(taken)} are registered already")
        _FORMATS[name] = Format(name, tuple(extensions), write, quantises)
        return write

    return add


def formats() -> dict[str, Format]:
    return dict(_FORMATS)


def of_path(path: str) -> str:
    """By suffix; a path without one is a folder of solver files."""
    suffix = Path(path).suffix.lower()
    for f in _FORMATS.values():
        if suffix in f.extensions:
            return f.name
    if not suffix:
        return "emod3d"
    raise ValueError(f"no format has the suffix {suffix!r}")


def flatten(model: DataFrame) -> DataFrame:
    """Columns in order, numbers in single precision; labels stand after the grid's name."""
    labels = [c for c in model.columns if c not in ("grid", *PLACE, *COMPONENTS)]
    single = [F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "depth", "nominal_depth", *COMPONENTS)]
    return model.select("grid", *labels, "i", "j", "k", *single)


def quantised(model: DataFrame) -> DataFrame:
    return model.withColumns({c: F.round(F.col(c) / QUANTUM) * QUANTUM for c in ("x", "y", "z", "depth")})


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; only a local master without one makes its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tetrafield-')}"
    return f"{root}/tetrafield/{what}-{uuid.uuid4().hex}"


def write(model: DataFrame, path: str, format: str | None = None, quantise: bool = False, **options: str) -> None:
    """options go to the format's writer, such as the sfile's solver."""
    own = _FORMATS[format or of_path(path)]
    if quantise and not own.quantises:
        raise ValueError(f"{own.name} can't hold quantised values")
    own.write(quantised(model) if quantise else model, path, **options)


@register("csv", (".csv",))
def to_csv(model: DataFrame, path: str) -> None:
    flatten(model).write.mode("overwrite").csv(path, header=True)


@register("parquet", (".parquet", ".pq"), quantises=True)
def to_parquet(model: DataFrame, path: str) -> None:
    """Partitioned by grid, so that a block is read without the others."""
    flatten(model).write.mode("overwrite").option("compression", "zstd").partitionBy("grid").parquet(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register("emod3d")
def to_emod3d(model: DataFrame, path: str) -> None:
    """Three files of single-precision numbers, in km/s and g/cm3. Blocks of one resolution only; executors write them."""
    binary.write(model, path)


@register("zarr", (".zarr",), quantises=True)
def to_zarr(model: DataFrame, path: str) -> None:
    """Chunked arrays by grid, a file for each chunk; executors write them."""
    arrays.write(model, path)


@register("sfile", (".sfile",))
def to_sfile(model: DataFrame, path: str, solver: str = "physical") -> None:
    """The solver's block layout as tables: j before i, materials by grid, interfaces by column, and attributes as JSON.

    Interfaces are where the solver believes its levels to be: at z, or at their nominal depths.
    """
    at = grids.solver_coordinate(solver)
    names = {"rho": "Rho", "vp": "Cp", "vs": "Cs", "qp": "Qp", "qs": "Qs"}
    model.select("grid", "j", "i", "k", *(F.col(a).cast("float").alias(b) for a, b in names.items())).write.mode("overwrite").partitionBy("grid").parquet(f"{path}/material")
    ends = model.groupBy("grid", "j", "i").agg(F.min(at).cast("float").alias("top"), F.max(at).cast("float").alias("bottom"))
    ends.write.mode("overwrite").parquet(f"{path}/interfaces")
    about = [r.asDict() for r in model.groupBy("grid").agg(F.max("i").alias("ni"), F.max("j").alias("nj"), F.max("k").alias("nk"), F.min(at).alias("min_z"), F.max(at).alias("max_z")).orderBy("grid").collect()]
    model.sparkSession.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/attributes")


def append(model: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Adds finished rows to a Parquet table, partitioned as it is; a failed task leaves nothing behind."""
    model.write.mode("append").partitionBy(*by).parquet(path)


def write_mesh(models: DataFrame, vertices: DataFrame, tets: DataFrame, path: str) -> None:
    """With each model's footprint, so that who looks for models in a place need not read their vertices."""
    models = models.drop("footprint").join(footprints.footprints(vertices), "model_id", "left")
    for name, table in (("models", models), ("vertices", vertices), ("tets", tets)):
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

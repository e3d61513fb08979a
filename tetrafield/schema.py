"""Names and types shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of components, fixed.
COMPONENTS = ("rho", "vp", "vs", "qp", "qs", "alpha")
FIELDS = COMPONENTS[:-1]
QUALITY = "struct<" + ", ".join(f"{c}: double" for c in COMPONENTS) + ">"

INTERPOLATE, DEPTH_PROFILE, CONSTANT = 1, 2, 3  # model types
ELEVATION, DEPTH = "elevation", "depth"  # verticals
RESERVED = frozenset(("grid", "i", "j", "k", "x", "y", "z", "depth", "nominal_depth", "coastline", *COMPONENTS))


@dataclass(frozen=True)
class ModelRange:
    """Priorities lo to hi, both included. The lower number wins."""

    lo: int
    hi: int

    def holds(self, priority: Column) -> Column:
        return priority.between(self.lo, self.hi)


BASINS, TOMOGRAPHY, ALL = ModelRange(0, 127), ModelRange(128, 255), ModelRange(0, 255)


def quality(**values: Column | float) -> Column:
    """A struct of the six components; those not given are 0."""
    return F.struct(*((values[c] if isinstance(values.get(c), Column) else F.lit(float(values.get(c, 0.0)))).cast("double").alias(c) for c in COMPONENTS))


def packed(prefix: str = "") -> Column:
    """The six flat columns as one struct."""
    return F.struct(*(F.col(prefix + c).cast("double").alias(c) for c in COMPONENTS))

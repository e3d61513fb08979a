"""Comparisons of numbers that a scan by blocks takes over as ranges."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

_KNOWN = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def taken(filters: Iterable[Filter], ranges: dict[str, list[int]]) -> Iterable[Filter]:
    """Narrows ranges (first, end excluded) of whole-numbered columns, and gives back the filters that Spark still has to apply."""
    for own in filters:
        name, value = ".".join(getattr(own, "attribute", ())), getattr(own, "value", None)
        if not isinstance(own, _KNOWN) or name not in ranges or not isinstance(value, (int, float)) or not math.isfinite(value):
            yield own
            continue
        r = ranges[name]
        if isinstance(own, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            r[0] = max(r[0], math.floor(value) + 1 if isinstance(own, GreaterThan) else math.ceil(value))
        if isinstance(own, (LessThan, LessThanOrEqual, EqualTo)):
            r[1] = min(r[1], math.ceil(value) if isinstance(own, LessThan) else math.floor(value) + 1)

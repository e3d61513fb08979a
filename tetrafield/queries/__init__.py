"""Registered queries of the sampling engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chains, construction, files, frames, points, products, rasters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (points, construction, rasters, chains, products, files, frames):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

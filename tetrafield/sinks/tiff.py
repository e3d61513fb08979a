"""Rasters written as tiled TIFF by executors: every tile has a slot of its own in the file, so tasks need not know of each other.

Slots are as long as a tile can become; deflated tiles leave the rest of theirs as a hole, which takes no room on disks that know holes.
A tile's rows meet in one task, one tile at a time. Tiles without rows are left out as the format allows. Rewriting a tile changes
nothing, so tasks can be tried again; the driver gets the tiles' lengths, writes the directory, and renames the file. A job
that fails removes it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources import tiff as form
from .assemble import assembled

NAME = "tetrafield_tiff_sink"
TILE = 256
CLASSIC = 4_000_000_000  # bytes up to which a file has 32-bit offsets
PER_TASK = 64  # tiles


def _head(tags: Sequence[tuple[int, int, Sequence]], big: bool) -> bytes:
    """Header and directory of (tag, kind, values), little-endian."""
    count, offset, inline = ("Q", "Q", 8) if big else ("H", "I", 4)
    start = 16 if big else 8
    at = start + struct.calcsize("<" + count) + len(tags) * (20 if big else 12) + inline
    rows, after = b"", b""
    for tag, kind, values in sorted(tags, key=lambda t: t[0]):
        raw = values if isinstance(values, bytes) else np.asarray(values).astype("<" + form.KINDS[kind]).tobytes()
        n = len(values)
        rows += struct.pack("<HH" + ("Q" if big else "I"), tag, kind, n)
        if len(raw) <= inline:
            rows += raw.ljust(inline, b"\0")
        else:
            rows += struct.pack("<" + offset, at + len(after))
            after += raw + b"\0" * (-len(raw) % 8)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    return head + struct.pack("<" + count, len(tags)) + rows + b"\0" * inline + after


@dataclass(frozen=True)
class Plan:
    shape: tuple[int, int]
    tile: int
    bands: int
    kind: str
    deflated: bool
    to_world: tuple[tuple[float, float, float], ...]
    epsg: int

    @property
    def across(self) -> int:
        return -(-self.shape[0] // self.tile)

    @property
    def tiles(self) -> int:
        return self.across * -(-self.shape[1] // self.tile)

    @property
    def slot(self) -> int:
        plain = self.tile * self.tile * self.bands * int(self.kind[1:])
        return plain + plain // 512 + 64 if self.deflated else plain

    @property
    def big(self) -> bool:
        return self.tiles * (self.slot + 8) > CLASSIC

    def head(self, offsets: np.ndarray, counts: np.ndarray) -> bytes:
        (a, b, c), (d, e, f) = self.to_world
        place, whole = [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1], 16 if self.big else 4
        keys = [1, 1, 0, 3, 1024, 0, 1, 1, form.RASTER_TYPE, 0, 1, form.POINT, form.PROJECTED_CRS, 0, 1, self.epsg]
        tags = [
            (form.WIDTH, 4, [self.shape[0]]), (form.HEIGHT, 4, [self.shape[1]]), (form.BITS, 3, [8 * int(self.kind[1:])] * self.bands),
            (form.COMPRESSION, 3, [form.DEFLATE[0] if self.deflated else form.PLAIN[0]]), (form.PHOTOMETRIC, 3, [1]), (form.SAMPLES, 3, [self.bands]),
            (form.PLANAR, 3, [1]), (form.TILE_WIDTH, 4, [self.tile]), (form.TILE_HEIGHT, 4, [self.tile]), (form.TILE_OFFSETS, whole, offsets),
            (form.TILE_COUNTS, whole, counts), (form.SAMPLE_FORMAT, 3, [3] * self.bands), (form.TRANSFORMATION, 12, place), (form.GEO_KEYS, 3, keys),
            (form.NO_DATA, 2, b"nan\0"),
        ]
        return _head(tags, self.big)

    @property
    def start(self) -> int:
        """Where the first slot is: the directory's length hangs on the number of tiles only."""
        none = np.zeros(self.tiles, "i8")
        return -(-len(self.head(none, none)) // 4096) * 4096


@dataclass
class Tiles(WriterCommitMessage):
    numbers: list[int]
    lengths: list[int]


class TiffWriter(DataSourceArrowWriter):
    def __init__(self, path: str, plan: Plan):
        self.path, self.plan, self.start = path, plan, plan.start
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(self.staging, "wb") as f:
            f.truncate(self.start + plan.tiles * plan.slot)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Tiles:
        p, done = self.plan, Tiles([], [])
        f = os.open(self.staging, os.O_WRONLY)
        try:
            for number, values in assembled(iterator, lambda _: p.tile * p.tile, "<" + p.kind):
                raw = zlib.compress(values.tobytes()) if p.deflated else values.tobytes()
                os.pwrite(f, raw, self.start + number * p.slot)
                done.numbers.append(number)
                done.lengths.append(len(raw))
        finally:
            os.fsync(f)
            os.close(f)
        return done

    def commit(self, messages: list[Tiles | None]) -> None:
        counts = np.zeros(self.plan.tiles, "i8")
        for m in messages:
            if m is not None:
                counts[m.numbers] = m.lengths
        offsets = np.where(counts > 0, self.start + np.arange(self.plan.tiles) * self.plan.slot, 0)
        with open(self.staging, "r+b") as f:
            f.write(self.plan.head(offsets, counts))
            os.fsync(f.fileno())
        os.replace(self.staging, self.path)

    def abort(self, messages: list[Tiles | None]) -> None:
        if os.path.exists(self.staging):
            os.remove(self.staging)


class TiffSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        o = self.options
        world = [float(v) for v in o["world"].split(",")]
        whole = lambda name: int(o[name])
        plan = Plan((whole("nx"), whole("ny")), whole("tile"), whole("bands"), o["kind"], o["deflated"] == "1", (tuple(world[:3]), tuple(world[3:])), whole("epsg"))
        return TiffWriter(form.mounted(o["path"]), plan)


def write(
    nodes: DataFrame, path: str, shape: tuple[int, int], values: Sequence[str] = ("z",), to_world: Sequence[Sequence[float]] = ((1, 0, 0), (0, 1, 0)),
    epsg: int = 2193, kind: str = "f4", compress: bool = True, tile: int = TILE,
) -> None:
    """nodes (ix, iy, values) as the bands of one file. Pixels without a row, NULL and NaN are no-data; a row outside the shape or given twice is an error."""
    if tile % 16 or tile <= 0 or kind not in ("f4", "f8"):
        raise ValueError("tiles are multiples of 16, numbers f4 or f8")
    nodes.sparkSession.dataSource.register(TiffSink)
    ix, iy, across = F.col("ix").cast("long"), F.col("iy").cast("long"), -(-shape[0] // tile)
    outside = (ix < 0) | (iy < 0) | (ix >= shape[0]) | (iy >= shape[1]) | ix.isNull() | iy.isNull()
    number = F.when(outside, F.raise_error(F.lit("a row lies outside the raster")).cast("long")).otherwise(F.floor(iy / tile) * across + F.floor(ix / tile))
    rows = nodes.select(number.cast("long").alias("tile"), (iy % tile * tile + ix % tile).alias("at"), *(F.col(v).cast("double").alias(f"v{n}") for n, v in enumerate(values)))
    tiles = across * -(-shape[1] // tile)
    dealt = rows.repartitionByRange(max(1, -(-tiles // PER_TASK)), "tile").sortWithinPartitions("tile", "at")
    options = {"nx": shape[0], "ny": shape[1], "tile": tile, "bands": len(values), "kind": kind, "deflated": int(compress), "epsg": epsg, "world": ",".join(repr(float(v)) for row in to_world for v in row)}
    dealt.write.format(NAME).options(**options).mode("append").save(path)

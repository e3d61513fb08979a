"""TIFF rasters as a data source: tasks read strips or tiles of a file, and ranges of columns and rows keep others unread.

Classic and big files of either byte order, in strips or tiles, bands beside each other or apart, plain or deflated, with the
predictors of whole and floating numbers. Anything else (LZW, JPEG, complex or packed numbers) is refused by name. A strip that
isn't compressed is read in pieces; a compressed one is decoded whole, so its size bounds a task's memory.

Rows are (ix, iy, b1, b2, ...): columns from the left, rows from the top, bands as doubles, and NULL for no-data, NaN and blocks that
the file leaves out. Comparisons of ix or iy with numbers are taken over by the scan. Bands to read are named, others aren't decoded
where they lie apart. The path has to be mounted by all executors.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from . import ranges

NAME = "tetrafield_tiff"
PART_BYTES = 64 << 20  # of values that a task reads
BATCH = 65_536

# Numbers of the public format: fixed values.
KINDS = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
RASTER_TYPE, PROJECTED_CRS = 1025, 3072  # geographic keys
POINT = 2  # raster type whose numbers stand for pixels' middles
PLAIN, DEFLATE = (1,), (8, 32946)
FORMATS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Table:
    """An array of numbers somewhere in the file."""

    kind: str
    count: int
    at: int

    def read(self, f: int, first: int = 0, count: int | None = None) -> np.ndarray:
        kind = np.dtype(self.kind)
        count = self.count - first if count is None else count
        return np.frombuffer(os.pread(f, count * kind.itemsize, self.at + first * kind.itemsize), kind)


@dataclass(frozen=True)
class Raster:
    """What a file's first directory tells."""

    path: str
    shape: tuple[int, int]  # columns and rows
    block: tuple[int, int]  # of a block read at once
    pieces: int  # of a strip that are blocks of their own
    strip_rows: int  # 0 for tiles
    kind: str
    bands: int
    apart: bool
    deflated: bool
    predictor: int
    no_data: float | None
    to_world: tuple[tuple[float, float, float], ...]  # from a pixel's numbers to its middle
    epsg: int | None
    offsets: Table
    counts: Table

    @property
    def across(self) -> int:
        return -(-self.shape[0] // self.block[0])

    @property
    def down(self) -> int:
        return self.row_of(self.shape[1] - 1) + 1

    def row_of(self, iy: int) -> int:
        """The row of blocks that holds a row of pixels."""
        if not self.strip_rows:
            return iy // self.block[1]
        return iy // self.strip_rows * self.pieces + iy % self.strip_rows // self.block[1]

    def rows(self, row: int) -> tuple[int, int]:
        """The rows of pixels, end excluded, of a row of blocks."""
        if not self.strip_rows:
            return row * self.block[1], min((row + 1) * self.block[1], self.shape[1])
        first = row // self.pieces * self.strip_rows
        start = first + row % self.pieces * self.block[1]
        return start, min(start + self.block[1], first + self.strip_rows, self.shape[1])

    def block_values(self, f: int, row: int, column: int, band: int | None) -> np.ndarray | None:
        """Values (row, column, band) of a block, or of one band's block where bands lie apart; None where the file leaves it out."""
        kind, (first, last) = np.dtype(self.kind), self.rows(row)
        samples = 1 if self.apart else self.bands
        line = self.block[0] * samples * kind.itemsize
        n = row // self.pieces * self.across + column
        if self.apart and band:
            n += band * self.across * -(-self.shape[1] // (self.strip_rows or self.block[1]))
        at, size = (int(t.read(f, n, 1)[0]) for t in (self.offsets, self.counts))
        if not size:
            return None
        stored = self.block[1] if not self.strip_rows else last - first
        if self.deflated:
            raw = zlib.decompress(os.pread(f, size, at))
        else:
            skip = (first - row // self.pieces * self.strip_rows) * line if self.strip_rows else 0
            raw = os.pread(f, min(stored * line, size - skip), at + skip)
        if len(raw) < stored * line:
            raise ValueError(f"{self.path}: a block holds {len(raw)} bytes in place of {stored * line}")
        raw = raw[: stored * line]
        if self.predictor == 3:
            own = np.frombuffer(raw, "u1").reshape(stored, -1, samples).cumsum(axis=1, dtype="u1").reshape(stored, kind.itemsize, -1)
            values = np.ascontiguousarray(own.transpose(0, 2, 1)).view(f">{self.kind[1:]}").reshape(stored, self.block[0], samples)
        else:
            values = np.frombuffer(raw, kind).reshape(stored, self.block[0], samples)
            if self.predictor == 2:
                values = values.cumsum(axis=1, dtype=kind.newbyteorder("="))
        return values[: last - first]


def mounted(path: str) -> str:
    scheme, rest = path.split(":", 1) if ":" in path.split("/", 1)[0] else ("file", path)
    if scheme != "file":
        raise ValueError(f"a TIFF needs a path that all executors mount, not {scheme}:")
    return "/" + rest.lstrip("/") if path.startswith("file:") else os.path.abspath(rest)


def _directory(f: int, path: str) -> tuple[str, dict[int, Table]]:
    head = os.pread(f, 16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order and len(head) >= 8 else None
    if version not in (42, 43):
        raise ValueError(f"{path} isn't a TIFF")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    size, width, inline = (8, 20, 8) if big else (2, 12, 4)
    n = int.from_bytes(os.pread(f, size, at), "little" if order == "<" else "big")
    raw, tags = os.pread(f, n * width, at + size), {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), raw, k * width)
        if kind not in KINDS:
            continue
        dtype = np.dtype(KINDS[kind]).newbyteorder(order)
        value = k * width + width - inline
        own = at + size + value if count * dtype.itemsize <= inline else struct.unpack_from(order + ("Q" if big else "I"), raw, value)[0]
        tags[tag] = Table(dtype.str, count, own)
    return order, tags


def _to_world(tags: dict[int, np.ndarray], keys: dict[int, int]) -> tuple[tuple[float, float, float], ...]:
    if TRANSFORMATION in tags:
        m = np.asarray(tags[TRANSFORMATION], float).reshape(4, 4)
        own = m[:2, [0, 1, 3]]
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (i, j, _, x, y), (sx, sy) = tags[TIEPOINT][:5], tags[PIXEL_SCALE][:2]
        own = np.array([[sx, 0.0, x - i * sx], [0.0, -sy, y + j * sy]])
    else:
        return (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)
    if keys.get(RASTER_TYPE) != POINT:  # numbers stand for pixels' corners
        own = np.column_stack([own[:, :2], own @ (0.5, 0.5, 1.0)])
    return tuple(tuple(map(float, r)) for r in own)


def about(path: str) -> Raster:
    """Reads a file's directory, none of its values."""
    path = mounted(path)
    f = os.open(path, os.O_RDONLY)
    try:
        order, tables = _directory(f, path)
        large = {STRIP_OFFSETS, STRIP_COUNTS, TILE_OFFSETS, TILE_COUNTS}
        tags = {k: t.read(f) for k, t in tables.items() if k not in large}
    finally:
        os.close(f)
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    width, height, bands, compression, predictor = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    bits, formats = set(map(int, tags.get(BITS, [1]))), set(map(int, tags.get(SAMPLE_FORMAT, [1])))
    if compression not in PLAIN + DEFLATE:
        raise ValueError(f"{path}: compression {compression} isn't known; plain and deflated files are")
    if len(bits) > 1 or len(formats) > 1 or not bits <= {8, 16, 32, 64} or not formats <= set(FORMATS):
        raise ValueError(f"{path}: numbers of {sorted(bits)} bits of format {sorted(formats)} aren't known")
    kind = f"{FORMATS[formats.pop()]}{bits.pop() // 8}"
    if kind == "f1" or predictor not in (1, 2, 3) or (predictor == 3) != (kind[0] == "f") and predictor != 1:
        raise ValueError(f"{path}: predictor {predictor} on {kind}")
    tiled = TILE_WIDTH in tags
    offsets, counts = (tables.get(t) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not width or not height or offsets is None or counts is None:
        raise ValueError(f"{path} lacks its size or its blocks")
    apart = one(PLANAR, 1) == 2 and bands > 1
    if tiled:
        strip_rows, pieces, block = 0, 1, (one(TILE_WIDTH), one(TILE_HEIGHT))
    else:
        strip_rows = min(one(STRIP_ROWS, height), height)
        fit = max(1, PART_BYTES // (width * (1 if apart else bands) * int(kind[1:])))
        rows = min(strip_rows, fit) if compression in PLAIN and predictor == 1 else strip_rows
        pieces, block = -(-strip_rows // rows), (width, rows)
    raw = tags.get(GEO_KEYS, np.zeros(4, int))
    keys = {int(k[0]): int(k[3]) for k in np.asarray(raw[4 : 4 + 4 * int(raw[3])]).reshape(-1, 4) if k[1] == 0}
    text = b"".join(tags[NO_DATA].tolist()).split(b"\0")[0].strip() if NO_DATA in tags else b""
    return Raster(
        path, (width, height), block, pieces, strip_rows, np.dtype(kind).newbyteorder(order).str, bands, apart, compression in DEFLATE, predictor,
        float(text) if text else None, _to_world(tags, keys), keys.get(PROJECTED_CRS), offsets, counts,
    )


class Span(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TiffReader(DataSourceReader):
    def __init__(self, path: str, bands: Sequence[int]):
        self.raster, self.bands = about(path), list(bands)
        self.ranges = {"ix": [0, self.raster.shape[0]], "iy": [0, self.raster.shape[1]]}  # ends excluded

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from ranges.taken(filters, self.ranges)

    def _blocks(self) -> tuple[int, int, int, int]:
        """First row and column of blocks in the ranges, and how many of each."""
        (x0, x1), (y0, y1) = self.ranges["ix"], self.ranges["iy"]
        if x0 >= x1 or y0 >= y1:
            return 0, 0, 0, 0
        r, w = self.raster, self.raster.block[0]
        return r.row_of(y0), x0 // w, r.row_of(y1 - 1) - r.row_of(y0) + 1, (x1 - 1) // w - x0 // w + 1

    def partitions(self) -> list[Span]:
        _, _, rows, columns = self._blocks()
        total, r = rows * columns, self.raster
        size = r.block[0] * r.block[1] * int(r.kind[2:]) * (len(self.bands) if r.apart else r.bands)
        step = max(1, PART_BYTES // size)
        return [Span(a, min(a + step, total)) for a in range(0, total, step)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        row0, column0, _, columns = self._blocks()
        names, r = ["ix", "iy", *(f"b{b}" for b in self.bands)], self.raster
        f = os.open(r.path, os.O_RDONLY)
        try:
            for n in range(partition.first, partition.last):
                row, column = row0 + n // columns, column0 + n % columns
                first, last = r.rows(row)
                y = np.arange(max(first, self.ranges["iy"][0]), min(last, self.ranges["iy"][1]))
                left = column * r.block[0]
                x = np.arange(max(left, self.ranges["ix"][0]), min(left + r.block[0], self.ranges["ix"][1]))
                held = {None: r.block_values(f, row, column, None)} if not r.apart else {b: r.block_values(f, row, column, b - 1) for b in self.bands}
                step = max(1, BATCH // max(1, len(x)))
                for a in range(0, len(y), step):
                    some = y[a : a + step]
                    arrays = [pa.array(np.tile(x, len(some))), pa.array(np.repeat(some, len(x)))]
                    for b in self.bands:
                        block = held[b if r.apart else None]
                        if block is None:
                            arrays.append(pa.nulls(len(some) * len(x), pa.float64()))
                            continue
                        own = block[some[0] - first : some[-1] + 1 - first, x[0] - left : x[-1] + 1 - left, 0 if r.apart else b - 1]
                        values = own.astype("f8").ravel()
                        lacking = np.isnan(values)
                        if r.no_data is not None:
                            lacking |= own.ravel() == np.dtype(r.kind).type(r.no_data) if r.kind[1] == "f" else values == r.no_data
                        arrays.append(pa.array(values, mask=lacking))
                    yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            os.close(f)


class Tiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _bands(self) -> list[int]:
        return [int(b) for b in self.options.get("bands", "1").split(",")]

    def schema(self) -> str:
        return "ix bigint, iy bigint, " + ", ".join(f"b{b} double" for b in self._bands())

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], self._bands())


def read(spark: SparkSession, path: str, bands: Sequence[int] = (1,)) -> DataFrame:
    """(ix, iy, b1, ...) of a file. Turns the session's pushdown of filters into Python data sources on, which plans ask for as they run."""
    has = about(path).bands
    if not bands or len(set(bands)) < len(bands) or not all(1 <= b <= has for b in bands):
        raise ValueError(f"{path} has bands 1 to {has}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tiff)
    return spark.read.format(NAME).option("bands", ",".join(map(str, bands))).load(path)

"""Models as chunked arrays (Zarr, version 3): a group for each grid, an array (i, j, k) for each number, a file for each chunk.

Rows are dealt out by ranges of chunks, so a chunk's rows meet in one task, which holds one chunk at a time and writes its file. Chunks
without rows are left out, and read as missing. Committing writes the metadata and renames the folder; a job that fails removes it.
Arrays are single precision, little-endian, compressed with gzip: codecs that every reader of the format has. Reading takes over comparisons of
i, j and k with numbers and of grid with a name; other chunks' files aren't opened. The path has to be mounted by all executors.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from ..schema import COMPONENTS
from ..sources import ranges
from .assemble import assembled
from .binary import local

NAME = "tetrafield_arrays"
CHUNK = (64, 64, 64)  # nodes of a chunk along i, j and k
PER_TASK = 16_000_000  # numbers that a task writes or reads
BATCH = 65_536
AXES = ("i", "j", "k")
VARIABLES = ("x", "y", "z", "depth", "nominal_depth", *COMPONENTS)
ABOUT = "zarr.json"


@dataclass(frozen=True)
class Block:
    """The chunks of a grid, numbered along i, j and k, from `start` on among those of all grids."""

    grid: str
    shape: tuple[int, int, int]
    chunk: tuple[int, int, int]
    start: int

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunk, strict=True))

    @property
    def end(self) -> int:
        return self.start + math.prod(self.counts)


def _blocks(shapes: Iterable[tuple[str, Sequence[int], Sequence[int]]]) -> list[Block]:
    found, start = [], 0
    for grid, shape, chunk in shapes:
        found.append(Block(grid, tuple(shape), tuple(min(c, n) for c, n in zip(chunk, shape, strict=True)), start))
        start = found[-1].end
    return found


def _array(block: Block, name: str) -> dict:
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(block.shape), "data_type": "float32", "fill_value": "NaN",
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(block.chunk)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 5}}],
        "dimension_names": list(AXES), "attributes": {"standard_name": name},
    }


@dataclass
class Done(WriterCommitMessage):
    chunks: int


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, blocks: list[Block], attributes: dict):
        self.path, self.blocks, self.attributes = path, blocks, attributes
        self.staging = f"{path}.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        block_of = lambda n: next(b for b in self.blocks if b.start <= n < b.end)
        done = Done(0)
        for number, values in assembled(iterator, lambda n: math.prod(block_of(n).chunk), "<f4"):
            block = block_of(number)
            place = "/".join(map(str, np.unravel_index(number - block.start, block.counts)))
            for c, name in enumerate(VARIABLES):
                file = f"{self.staging}/{block.grid}/{name}/c/{place}"
                os.makedirs(os.path.dirname(file), exist_ok=True)
                with open(f"{file}.{uuid.uuid4().hex}", "wb") as f:  # a second attempt may be at the same chunk
                    f.write(gzip.compress(np.ascontiguousarray(values[:, c]).tobytes(), 5, mtime=0))
                os.replace(f.name, file)
            done.chunks += 1
        return done

    def commit(self, messages: list[Done | None]) -> None:
        group = {"zarr_format": 3, "node_type": "group"}
        about = {"": group | {"attributes": self.attributes}}
        for b in self.blocks:
            about[f"{b.grid}/"] = group | {"attributes": {}}
            about |= {f"{b.grid}/{name}/": _array(b, name) for name in VARIABLES}
        for folder, own in about.items():
            os.makedirs(f"{self.staging}/{folder}", exist_ok=True)
            with open(f"{self.staging}/{folder}{ABOUT}", "w") as f:
                json.dump(own, f, indent=1)
        if os.path.exists(self.path):
            old = f"{self.path}.old-{uuid.uuid4().hex}"
            os.replace(self.path, old)
            os.replace(self.staging, self.path)
            shutil.rmtree(old)
        else:
            os.replace(self.staging, self.path)

    def abort(self, messages: list[Done | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Span(InputPartition):
    def __init__(self, block: Block, first: int, last: int):
        self.block, self.first, self.last = block, first, last


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, variables: list[str]):
        self.path, self.variables, self.blocks = path, variables, store(path)
        self.ranges = {a: [0, max((b.shape[n] for b in self.blocks), default=0)] for n, a in enumerate(AXES)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for own in ranges.taken(filters, self.ranges):
            if isinstance(own, EqualTo) and own.attribute == ("grid",):
                self.blocks = [b for b in self.blocks if b.grid == own.value]
            else:
                yield own

    def _window(self, block: Block) -> list[tuple[int, int]]:
        return [(r[0], min(r[1], n)) for r, n in zip(self.ranges.values(), block.shape, strict=True)]

    def _chunks(self, block: Block) -> list[range]:
        """Numbers of chunks along each axis that the ranges meet."""
        return [range(a // c, -(-b // c)) if a < b else range(0) for (a, b), c in zip(self._window(block), block.chunk, strict=True)]

    def partitions(self) -> list[Span]:
        spans = []
        for b in self.blocks:
            total, step = math.prod(map(len, self._chunks(b))), max(1, PER_TASK // (math.prod(b.chunk) * len(self.variables)))
            spans += [Span(b, a, min(a + step, total)) for a in range(0, total, step)]
        return spans or [Span(Block("", (0, 0, 0), (1, 1, 1), 0), 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        b, names = partition.block, ["grid", *AXES, *self.variables]
        for chunk in itertools.islice(itertools.product(*self._chunks(b)), partition.first, partition.last):
            inside = [(max(lo, n * c), min(hi, (n + 1) * c)) for (lo, hi), n, c in zip(self._window(b), chunk, b.chunk, strict=True)]
            cut = tuple(slice(lo - n * c, hi - n * c) for (lo, hi), n, c in zip(inside, chunk, b.chunk, strict=True))
            at = [a.ravel() for a in np.meshgrid(*(np.arange(lo, hi) for lo, hi in inside), indexing="ij")]
            held = []
            for v in self.variables:
                file = f"{self.path}/{b.grid}/{v}/c/{'/'.join(map(str, chunk))}"
                if not os.path.exists(file):
                    held.append(np.full(len(at[0]), np.nan, "f4"))
                    continue
                with open(file, "rb") as f:
                    held.append(np.frombuffer(gzip.decompress(f.read()), "<f4").reshape(b.chunk)[cut].ravel())
            for first in range(0, len(at[0]), BATCH):
                some = slice(first, first + BATCH)
                n = len(at[0][some])
                arrays = [pa.array([b.grid]).take(pa.array(np.zeros(n, "i4"))), *(pa.array(a[some]) for a in at)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(h[some], mask=np.isnan(h[some])) for h in held)], names)


class Arrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _variables(self) -> list[str]:
        return self.options.get("variables", ",".join(VARIABLES)).split(",")

    def schema(self) -> str:
        return ", ".join(["grid string", *(f"{a} bigint" for a in AXES), *(f"{v} float" for v in self._variables())])

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(local(self.options["path"]), self._variables())

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        own = json.loads(self.options["blocks"])
        return ArrayWriter(local(self.options["path"]), _blocks(own), json.loads(self.options["attributes"]))


def store(path: str) -> list[Block]:
    """The grids of a store, by name. Others' stores are read if they have this layout."""
    path, found = local(path), []
    if not os.path.exists(f"{path}/{ABOUT}"):
        raise ValueError(f"{path} holds no arrays")
    for grid in sorted(e.name for e in os.scandir(path) if e.is_dir()):
        shapes = set()
        for name in sorted(e.name for e in os.scandir(f"{path}/{grid}") if e.is_dir()):
            with open(f"{path}/{grid}/{name}/{ABOUT}") as f:
                own = json.load(f)
            like = _array(Block("", tuple(own["shape"]), tuple(own["chunk_grid"]["configuration"]["chunk_shape"]), 0), name)
            codecs = [(c["name"], c.get("configuration", {}).get("endian")) for c in own["codecs"]]
            if own["data_type"] != "float32" or codecs != [("bytes", "little"), ("gzip", None)] or own["chunk_key_encoding"] != like["chunk_key_encoding"] or len(own["shape"]) != 3:
                raise ValueError(f"{path}/{grid}/{name} isn't an array of single-precision numbers along i, j and k under gzip")
            shapes.add((tuple(own["shape"]), tuple(like["chunk_grid"]["configuration"]["chunk_shape"])))
        if len(shapes) > 1:
            raise ValueError(f"the arrays of {grid} differ in shape")
        found += [(grid, *s) for s in shapes]
    return _blocks(found)


def write(model: DataFrame, path: str, chunk: tuple[int, int, int] = CHUNK, attributes: dict | None = None) -> None:
    """A sampled model, its grids apart. Nodes without a row are missing; two rows of one node and columns of labels are errors."""
    labels = [c for c in model.columns if c not in ("grid", *AXES, *VARIABLES)]
    if labels:
        raise ValueError(f"arrays hold numbers, not labels such as {labels[0]!r}")
    spark = model.sparkSession
    spark.dataSource.register(Arrays)
    sizes = model.groupBy("grid").agg(*(F.max(a) + 1 for a in AXES), *(F.min(a) for a in AXES), *(F.count(F.when(F.col(a).isNull(), 1)) for a in AXES))
    shapes = sorted((r[0], [int(n) for n in r[1:4]], r[4:]) for r in sizes.collect() if r[0] is not None and None not in r)  # a row for each grid
    if any(min(s[2][:3]) < 0 or any(s[2][3:]) for s in shapes) or not model.filter("grid IS NULL").isEmpty():
        raise ValueError("grids have names, and nodes are numbered from 0")
    if any("/" in s[0] or s[0] in ("", ".", "..") for s in shapes):
        raise ValueError("grids' names have to do for folders")
    blocks = _blocks((g, s, chunk) for g, s, _ in shapes)
    number, at = F.lit(None).cast("long"), F.lit(None).cast("long")
    for b in blocks:
        own, place = F.lit(0), F.lit(0)
        for a, n, c in zip(AXES, b.counts, b.chunk, strict=True):
            own, place = own * n + F.floor(F.col(a) / c), place * c + F.col(a) % c
        here = F.col("grid") == b.grid
        number, at = F.when(here, own + b.start).otherwise(number), F.when(here, place).otherwise(at)
    rows = model.select(number.cast("long").alias("block"), at.cast("long").alias("at"), *(F.col(v).cast("float").alias(v) for v in VARIABLES))
    total = sum(math.prod(b.shape) for b in blocks) * len(VARIABLES)
    dealt = rows.repartitionByRange(max(1, -(-total // PER_TASK)), "block").sortWithinPartitions("block", "at")
    told = json.dumps([(b.grid, b.shape, b.chunk) for b in blocks])
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    dealt.write.format(NAME).option("blocks", told).option("attributes", json.dumps(attributes or {})).mode("append").save(path)


def read(spark: SparkSession, path: str, variables: Sequence[str] = VARIABLES) -> DataFrame:
    """(grid, i, j, k, variables). Turns the session's pushdown of filters into Python data sources on, which plans ask for as they run."""
    if not variables or not set(variables) <= set(VARIABLES):
        raise ValueError(f"variables are {', '.join(VARIABLES)}")
    store(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Arrays)
    return spark.read.format(NAME).option("variables", ",".join(variables)).load(path)

"""The solver's binary blocks as a data source: executors write and read ranges of the files themselves.

A block is one file for each component, of single-precision numbers in a fixed order. A writing task puts its rows where they belong in
staging files of the final size; rewriting a range changes nothing, so tasks can be tried again. Committing checks that every
number was written once and renames the files; a job that fails removes them. No number passes the driver.

The path has to lie on a file system that the driver and all executors mount; other places are refused.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "tetrafield_blocks"
RANGE = 4_000_000  # numbers of a file that a task writes or reads
BATCH = 65_536
# Files and the components they hold: fixed values.
FILES = {"rho": "rho3dfile.d", "vp": "vp3dfile.p", "vs": "vs3dfile.s"}


def local(path: str) -> str:
    scheme, rest = path.split(":", 1) if ":" in path.split("/", 1)[0] else ("file", path)
    if scheme != "file":
        raise ValueError(f"binary blocks need a path that all executors mount, not {scheme}:")
    return "/" + rest.lstrip("/") if path.startswith("file:") else os.path.abspath(rest)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, path: str, total: int):
        self.path, self.total = path, total
        self.staging = f"{path}/.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)
        for name in FILES.values():
            with open(f"{self.staging}/{name}", "wb") as f:
                f.truncate(4 * total)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, rows, last = {c: os.open(f"{self.staging}/{n}", os.O_WRONLY) for c, n in FILES.items()}, 0, -1
        try:
            for batch in iterator:
                at = batch.column("at").to_numpy()
                if not len(at):
                    continue
                if at[0] <= last or (np.diff(at) <= 0).any():
                    raise ValueError("two rows have the same place in the block")
                if at[-1] >= self.total or at[0] < 0:
                    raise ValueError("a row lies outside the block")
                runs = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1)
                for c, f in files.items():
                    values = batch.column(c).to_numpy(zero_copy_only=False).astype("<f4")
                    for run in runs:
                        os.pwrite(f, values[run[0] : run[-1] + 1].tobytes(), 4 * int(at[run[0]]))
                rows, last = rows + len(at), at[-1]
        finally:
            for f in files.values():
                os.fsync(f)
                os.close(f)
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        rows = sum(m.rows for m in messages if m is not None)
        if rows != self.total:
            self.abort(messages)
            raise ValueError(f"the block has {self.total} places, and {rows} rows came")
        for name in FILES.values():
            os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
        os.rmdir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlockReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        sizes = {os.path.getsize(f"{path}/{n}") for n in FILES.values()}
        if len(sizes) > 1 or sizes == {0} or next(iter(sizes)) % 4:
            raise ValueError(f"the files in {path} don't hold one block")
        self.total = sizes.pop() // 4

    def partitions(self) -> list[Range]:
        return [Range(a, min(a + RANGE, self.total)) for a in range(0, self.total, RANGE)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.last, BATCH):
            n, columns = min(BATCH, partition.last - first), [pa.array(np.arange(first, min(first + BATCH, partition.last)))]
            for name in FILES.values():
                with open(f"{self.path}/{name}", "rb") as f:
                    columns.append(pa.array(np.frombuffer(os.pread(f.fileno(), 4 * n, 4 * first), "<f4")))
            yield pa.RecordBatch.from_arrays(columns, ["at", *FILES])


class Blocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "at bigint, " + ", ".join(f"{c} float" for c in FILES)

    def reader(self, schema) -> BlockReader:
        return BlockReader(local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(local(self.options["path"]), int(self.options["total"]))


def write(model: DataFrame, path: str) -> tuple[int, int, int]:
    """Writes one full block (grid, i, j, k, rho, vp, vs in metres and kilograms) in km/s and g/cm3: j from its last, then k, then i. Returns its shape."""
    spark = model.sparkSession
    spark.dataSource.register(Blocks)
    r = model.agg(F.countDistinct("grid"), F.max("i") + 1, F.max("j") + 1, F.max("k") + 1, F.count(F.lit(1))).first()
    if r[0] != 1 or r[4] != r[1] * r[2] * r[3]:
        raise ValueError("the solver's files hold one full block")
    ni, nj, nk, total = map(int, r[1:])
    at = ((nj - 1 - F.col("j")) * nk + F.col("k")) * ni + F.col("i")
    rows = model.select(at.cast("long").alias("at"), *((F.col(c) / 1000).cast("float").alias(c) for c in FILES))
    dealt = rows.repartitionByRange(max(1, -(-total // RANGE)), "at").sortWithinPartitions("at")
    os.makedirs(local(path), exist_ok=True)
    dealt.write.format(NAME).option("total", total).mode("append").save(path)
    return ni, nj, nk


def read(spark: SparkSession, path: str, shape: tuple[int, int, int]) -> DataFrame:
    """(i, j, k, rho, vp, vs) of a block, as they stand in its files."""
    spark.dataSource.register(Blocks)
    ni, nj, nk = shape
    at = F.col("at")
    rows = spark.read.format(NAME).load(path)
    row = F.floor(at / ni)
    return rows.select((at % ni).alias("i"), (nj - 1 - F.floor(row / nk)).alias("j"), (row % nk).alias("k"), *FILES)

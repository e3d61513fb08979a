"""What the operators share: table reads, materialising to the shared folder, and small column helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space and words of the contracts: these six characters only, not Unicode's.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it; only a local master (tests) makes one of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tetrafield-')}"
        with contextlib.suppress(Exception):  # a static setting of some versions: then a folder for each call
            spark.conf.set("spark.checkpoint.dir", named)
    return named


class Written:
    """Cuts lineage with tables written to the shared folder: they outlive lost executors.

    Tables of superseded rounds are removed with `drop`; those that a returned DataFrame still reads stay.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tetrafield/{what}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_but(self, *names: str) -> None:
        """Removes all tables but these."""
        for name in [n for n in self.paths if n not in names]:
            self.drop(name)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


TEXT_ROWS = 1024
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, where it has Spark's default: 10,000 whole texts at once are what workers' memory goes to.

    Plans run after their operator has returned, so the setting has to stay.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(TEXT_ROWS))


def give_back() -> None:
    """Returns what a worker has freed to the system, at the end of a task: idle workers stay beside those of later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Rows of an Arrow batch in the jobs that run within: with whole texts in them, batches are what workers' memory goes to."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; F.lower would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

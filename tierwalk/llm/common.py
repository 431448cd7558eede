"""Helpers that all training-data operators share: shared work tables, shipping, document views."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tierwalk.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get())
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tierwalk-"))
    return str(sc._jsc.sc().getCheckpointDir().get())


class Work:
    """Tables of one run in the shared folder. A written table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and reads it again; the schema is kept, so an empty table is read as well."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Removes all tables of the run, once its result doesn't read them any more."""
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only these columns; any others, whatever their names, are left behind before an operator adds its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def tidy(make):
    """make (batches to batches), after which a task's freed memory goes back to the system: an idle worker would keep it beside those of later stages."""

    def run(batches):
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
            if trim:
                trim(0)

    return run


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def sliced(batches, rows: int):
    """The batches in slices of at most `rows` rows, as views.

    Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default) except for a single longer
    row, and by 10,000 rows; what a function builds from a slice is bounded by this number besides.
    """
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)

"""Tables that one run of an operator writes, so that nothing before them is computed again."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from leadcurve.sources.tables import work_folder


class Work:
    """A folder of its own under ``spark.checkpoint.dir`` for one run.

    ``keep`` writes a table and reads it back with its declared schema: the
    lineage ends there, and a lost executor costs nothing that lies before.
    ``drop`` removes what no result reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_folder(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per session, through Spark's own file service."""
    context = spark.sparkContext
    name = "leadcurve.zip"
    if any(f.endswith(name) for f in context._python_includes):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="leadcurve-code-")) / name
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives freed memory back to the system when it ends.

    Python workers live on after a task, beside an executor whose memory
    limit covers them; what an allocator keeps would add up over operators.
    """

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied

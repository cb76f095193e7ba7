"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode, where it is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pointloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


#: Rows of whole texts that go to Python at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, unless it has a setting of its own: texts are long, and Spark's 10,000
    rows are held several times over on their way."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends; else they fill the executors' disks until the driver happens to
    collect its garbage. A query that is only planned inside isn't affected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written once and read again, so that a lost executor never costs more than the step under way."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        small_batches(spark)
        self.base = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()  # noqa: SLF001
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # noqa: SLF001
            path.getFileSystem(conf).delete(path, True)

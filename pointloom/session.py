"""A session with the settings that the operators count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: ANSI casts, UTC and adaptive plans; sizes stay with the cluster's own settings.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build(app: str = "pointloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode, where that is unset."""
    name = f"pointloom-{uuid.uuid4().hex}"
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return f"{base.rstrip('/')}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix=name)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"

"""Session helpers shared by sources, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "chronoveil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, which do not see the path of the script that imported it."""
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(spark.sparkContext, "_chronoveil_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="chronoveil-")  # the driver serves the archive as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(os.path.join(folder, "chronoveil"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._chronoveil_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on: UTC instants, and skewed joins split even where that costs a shuffle."""
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
                       "spark.sql.adaptive.skewJoin.enabled": "true",
                       "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none and everything runs in one process (tests, local mode) a temporary one is made and
    set; a cluster without a shared folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    path = tempfile.mkdtemp(prefix="chronoveil-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, honouring the cluster's own folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = shared_dir(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

"""Session defaults and durable intermediate tables.

Intermediates are parquet tables in the shared folder named by ``spark.checkpoint.dir``, so a lost executor costs a
re-read and never a failed job.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmesh")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their Python already looks where it lies."""
    app = spark.sparkContext.applicationId
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if app in _shipped or str(_ROOT) in map(os.path.realpath, filter(None, known)):
        return
    _shipped.add(app)
    folder = tempfile.mkdtemp(prefix="quillmesh-package-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/quillmesh-package", "zip", _ROOT, "quillmesh"))


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where the session names none (tests, local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quillmesh/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table written by ``materialize``."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone at exit
            pass

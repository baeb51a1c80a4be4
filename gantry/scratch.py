"""The folder that driver and executors share, and what this application keeps in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession

_made: set[str] = set()  # folders that stand in for a shared one; they go as a whole when Python ends


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on a local master, as in tests; on a cluster,
    whose executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set")
            found = tempfile.mkdtemp(prefix="gantry-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            context.setCheckpointDir(found)
            _made.add(context.getCheckpointDir().rstrip("/"))
    return found.rstrip("/")


@lru_cache(maxsize=16)
def _run_dir(shared: str, application: str) -> str:
    folder = f"{shared}/gantry-{application}"

    def delete() -> None:
        try:
            if (session := SparkSession.getActiveSession()) is not None:
                deleted(session, folder)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            pass

    if shared not in _made:  # else the whole folder goes anyway
        atexit.register(delete)
    return folder


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; deleted when Python ends, as results may read them until then."""
    return _run_dir(shared_dir(spark), spark.sparkContext.applicationId)


def deleted(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

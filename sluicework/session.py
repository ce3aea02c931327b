"""Session helpers: scoped settings, the shared scratch folder, SQL function registration."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


@contextlib.contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]):
    """Set SQL options while a plan is analysed, then put the old values back.

    Spark copies the options that matter into the expressions at analysis, so
    the plan keeps them after the block ends.
    """
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active SparkSession")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder the cluster names.

    Only a local session without that setting falls back to the machine's
    temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="sluicework-")
    return f"{base.rstrip('/')}/sluicework/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that ``scratch_dir`` named."""
    if "/sluicework/" not in path:
        raise ValueError(f"{path} is no scratch folder")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

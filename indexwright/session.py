"""Session settings the jobs rely on, and the durable checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings every job assumes. Skew handling and partition coalescing are
#: adaptive, so the shuffle partition count only has to be large enough.
JOB_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(name: str = "indexwright", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session somebody else created."""
    for key, value in JOB_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is set and
    everything runs in one process (a test) is a temporary folder made, once per
    session; elsewhere its executors would each write a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _FALLBACK:
        _FALLBACK["folder"] = tempfile.mkdtemp(prefix="indexwright-")
    return _FALLBACK["folder"]


_FALLBACK: dict[str, str] = {}

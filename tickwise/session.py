"""SparkSession construction and the shared checkpoint folder.

Cluster deployments pass their own settings (``spark-submit --conf``); the
builder only fills what they leave unset, so a cluster's ``spark.checkpoint.dir``
or shuffle sizing always wins over these local defaults.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings every job relies on: UTC day boundaries for quotas, ANSI kept on
# (indicator code spells out its divisions), AQE for runtime re-planning
# (coalescing, skew splits, runtime broadcast of genuinely small sides).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "tickwise",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the defaults above for what the submit didn't set;
    ``extra`` and ``shuffle_partitions`` are the caller's own settings."""
    submitted = SparkConf()  # what spark-submit and spark-defaults give
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {k: v for k, v in _DEFAULTS.items() if not submitted.contains(k)}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:
        pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a session in one process (tests, local runs) may leave it unset and
    gets a private folder; elsewhere a machine's own folder would be unseen by
    the other machines, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    configured = tempfile.mkdtemp(prefix="tickwise-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, in the form that the cluster gives
    it; Spark's writers create it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

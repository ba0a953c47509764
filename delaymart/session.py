"""Session defaults and the shared work folder.

Everything the library writes between layers (Bronze CSV, Silver Parquet,
Gold tables, fitted models) goes under the folder the cluster names in
``spark.checkpoint.dir``. Only when that is unset (local runs, tests) do we
create one ourselves.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

# Settings every job relies on: UTC dates, AQE for runtime
# shuffle sizing, and skew-join splitting for hot keys. Broadcasts: the
# planner's static threshold stays at Spark's conservative 10 MB of estimated
# size; AQE may broadcast a larger side (up to 32 MB) only after measuring
# its materialized shuffle output, i.e. against a checked size.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Those of them that concern results and skew, not the cluster's memory.
PLAN_DEFAULTS = ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")


def build_session(master: str | None = None, app: str = "delaymart",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession, names: Iterable[str] = tuple(SESSION_DEFAULTS)) -> None:
    """Apply the named runtime SQL settings to an existing session (the driver's)."""
    for k, v in ((name, SESSION_DEFAULTS[name]) for name in names):
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings are left as they are
            pass


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written layers: ``spark.checkpoint.dir`` if the
    cluster names one, else the context's checkpoint dir. Only a local-mode
    session (tests, one machine) may fall back to a fresh temporary folder,
    which is then registered as its checkpoint dir; on a cluster a
    machine-local folder would not be shared, so that is an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="delaymart-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def run_folder(spark: SparkSession, *parts: str) -> str:
    """A folder under the checkpoint root that is unique to this application."""
    app = spark.sparkContext.applicationId or uuid.uuid4().hex
    return "/".join([checkpoint_root(spark), "delaymart", app, *parts])


def scale_settings(input_bytes: int, partition_bytes: int = 256 << 20,
                   scan_split_bytes: int = 512 << 20) -> dict[str, str]:
    """Runtime SQL settings sized for an input of ``input_bytes``.

    The heaviest shuffle is the per-order reduction of the line items, so
    the initial shuffle partition count is input / ``partition_bytes`` (AQE
    then merges small ones toward the same advisory size); scans split files
    at ``scan_split_bytes``; a partition is treated as skewed above twice the
    advisory size, so AQE splits it before it outgrows an executor."""
    n = max(200, int(input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int, **kw) -> dict[str, str]:
    conf = scale_settings(input_bytes, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf

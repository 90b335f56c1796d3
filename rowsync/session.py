"""Session defaults and the shared scratch location.

Everything a job writes outside its declared tables (streaming checkpoints,
lineage cuts, run scratch) goes under ``spark.checkpoint.dir``: on a cluster
that is a shared folder named by the cluster config; only when it is unset
(local tests) do we pick one ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces partitions at
# runtime; UTC keeps timestamp text stable; ANSI makes bad casts fail loudly,
# which is why untrusted input goes through try_* functions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # last duplicate key wins when parsing JSON into a variant
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Largest key set (bytes) of a micro-batch that is broadcast into a semi join
# with a sink table, so that the table is probed in place. A trigger normally
# bounds a micro-batch, but a catch-up after an outage can be the whole backlog,
# so the jobs measure the keys first and leave a bigger set to AQE's join choice;
# both ways give the same rows.
BROADCAST_MAX_BYTES = 64 << 20
ROW_BYTES = 64  # a row's share of a hashed relation, besides the bytes of its text


def fits_broadcast(n_rows: int, text_bytes: int | None = 0) -> bool:
    return n_rows * ROW_BYTES + (text_bytes or 0) <= BROADCAST_MAX_BYTES


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rowsync", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the library defaults; used by tests and bench."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL defaults to an existing session (driver-provided)."""
    for k, v in DEFAULTS.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep what the cluster set
            pass
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Read from the session (``spark.checkpoint.dir``); only when the cluster did
    not name one (local runs, tests) do we create our own and register it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        root = tempfile.mkdtemp(prefix="rowsync-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root (created by the
    first write into it)."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

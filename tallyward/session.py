"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings every plan here assumes. Partition counts are left to AQE,
# which coalesces from the initial number; executors, memory and cores are the
# cluster's business.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Call sites in error messages cost several round trips for each column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "tallyward", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in _RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and streaming checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) is a local folder chosen, once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="tallyward-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local

"""Session settings and the shared folder for written layers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A join on (incident, component, driver) may reuse a layout hashed on
    # (incident, component) instead of shuffling both sides again.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # The action context is one wide projection; keep its text out of the listener's heap.
    "spark.sql.maxPlanStringLength": "50000",
    "spark.sql.ui.explainMode": "simple",
}

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "causeway", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="causeway-")
    return _LOCAL_ROOTS[app]


def write_layer(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage by writing a Parquet table that outlives any executor; ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/causeway/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_layers(spark: SparkSession) -> None:
    """Remove the layers that this application has written. Frames that read them can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/causeway/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session settings, the shared work folder and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "headersieve", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is written for.

    Anything the cluster already sets (executors, memory, shuffle partitions)
    is left alone; pass ``conf`` to override.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Longer generated methods are never compiled to machine code.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a fresh temporary folder. A real
    cluster without it is an error: a machine-local folder would lose data
    together with the machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        if context.master.partition("[")[0] != "local":  # local-cluster has executors of its own
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="headersieve-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with ``options`` of the writer, and continue from the written table.

    This cuts the lineage so that a lost executor costs a re-read instead of a
    recomputation, freezes anything whose order is only settled at run time,
    and gives later joins the table's real size.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

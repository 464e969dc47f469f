"""Session defaults, small local tables and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "mailprism", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no stack capture per column expression
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by the cluster. Where none is set, a local session gets a temporary one; on a cluster that
    folder would be another one on every machine, so there it is an error."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} has to name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="mailprism-")
        spark.conf.set(CHECKPOINT_KEY, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    token = os.urandom(6).hex()
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{token}"


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Driver rows as a local relation, whose known size lets Catalyst pick a broadcast."""
    struct = StructType.fromDDL(schema)
    names = struct.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)

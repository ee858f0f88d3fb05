"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}


def build_session(app: str = "tickloom", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf) -> SparkSession:
    """UTC clock, AQE with skew handling; cluster settings win where given."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # methods beyond 8000 bytes are never compiled by the JVM: rather run those stages operator by operator
         .config("spark.sql.codegen.hugeMethodLimit", "8000")
         # checkpoints go when nothing refers to them any more
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
        if master.startswith("local"):      # small inputs: keep all cores busy after a shuffle
            b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        b = b.config(key, value)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. On a local master alone, where there is no cluster to share with, an unset folder
    is made for the session; on any other master it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _OWN.get(spark.sparkContext.applicationId)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tickloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A large result that several jobs read: written once to the shared folder, so that none of them computes it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Compute a small result once and cut its lineage through a reliable checkpoint."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)

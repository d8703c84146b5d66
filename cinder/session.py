"""Session helpers: building a session, the shared checkpoint folder, lineage cuts.

Nothing here changes how Spark plans a query.  Derived tables are joined without
hints: Spark broadcasts a side by its bytes, else it shuffles.  Only the joins of
``llm.simhash`` and ``llm.components``, where bytes mislead, ask for a shuffle.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Temporary shared folders of local-mode applications that name none.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "cinder") -> SparkSession:
    """Session with the settings every job here assumes (AQE on, UTC, UI off)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("CINDER_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and job state.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode
    session (tests, laptop runs) without that setting gets a temporary folder,
    one per application; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        if sc.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="cinder-ckpt-")
        shared = _LOCAL_DIRS[sc.applicationId]
    sc.setCheckpointDir(shared)
    return shared.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, the
    rows survive lost executors, and Spark plans later joins with real sizes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one written table."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

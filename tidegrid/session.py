"""Session helpers: building a session and the shared folder for cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's plans are written for."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; only a local run without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", "")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared checkpoint folder, for a table that a plan writes and reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor cannot change what later stages read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, without a PYTHONPATH of their own.

    On a cluster without that folder the package has to be installed or shipped as usual.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])

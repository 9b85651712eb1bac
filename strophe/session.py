"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: Any) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strophe")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a temporary folder of its own;
    on a cluster a folder that only one machine sees would lose what other machines wrote."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if getattr(shared_dir, "_own", None) is None:
        shared_dir._own = "file://" + tempfile.mkdtemp(prefix="strophe-")  # type: ignore[attr-defined]
    return shared_dir._own  # type: ignore[attr-defined]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local one: executors may be lost). The files go with the
    DataFrame that nothing refers to any more where the session sets spark.cleaner.referenceTracking.cleanCheckpoints."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory: a parquet file or a folder of part files."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

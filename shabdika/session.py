"""Session helpers: sensible defaults for a local run, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Settings a session of ours wants; a session made elsewhere is left as it is.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_WRITTEN: list[str] = []


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("shabdika")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. A single-machine session without one gets a temporary folder; on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="shabdika-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df`: its rows are written as a table to the shared folder and read again.

    A columnar, compressed table takes a fraction of a checkpoint's disk, later readers take only the
    columns they need, and no executor's loss can lose it. This runs a job at once. `clean` removes
    what was written.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> pd.DataFrame:
    """A bounded frame on the driver, by Arrow whatever the session's settings: rows that come one by one take many times their size there."""
    return df.toArrow().to_pandas()


def clean(spark: SparkSession) -> int:
    """Remove the tables that `cut` wrote in this process; frames made from them can't be read after that. Returns how many were removed."""
    jvm, n = spark.sparkContext._jvm, len(_WRITTEN)
    while _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n

"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def temporary_dir() -> str:
    """A folder of this machine for a local session, removed when the process ends."""
    at = tempfile.mkdtemp(prefix="tessellon-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set from spark.checkpoint.dir, or for a local master to a temporary folder."""
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = temporary_dir()
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; survives the loss of executors.

    A checkpoint inherits the size estimated for its plan; in a loop these
    estimates multiply until they overflow. The result is therefore a frame of
    the checkpoint's rows alone, which adaptive execution sizes as it runs.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def keep(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as a compressed table and read from there; survives the loss of executors.

    For wide rows and texts, of which later steps read some columns each: cut
    keeps whole rows uncompressed.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads no more than max_rows + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows

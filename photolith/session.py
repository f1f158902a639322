"""What a session needs before its executors can run the library's functions."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    copy = tempfile.mkdtemp(prefix="photolith-code-")
    shutil.copytree(here, f"{copy}/code/photolith", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{copy}/photolith", "zip", f"{copy}/code"))
    _shipped.add(context.applicationId)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; on one machine, as in tests, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="photolith-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the checkpoint folder."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, for a loop of many rounds: a checkpoint keeps what the planner knew of its plan (its size as a product
    over all joins, and what its columns equal), which grows with each round until planning takes all the time."""
    path = f"{_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting lineage through the folder that the whole cluster shares, and names that clash with none."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set: a temporary one in local mode (tests), elsewhere an error,
    for executors do not share such a folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not configured and current.isDefined():
        return current.get()
    if not configured:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="planframe-checkpoint-")
    if not current.isDefined():
        context.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and returns it read from the shared checkpoint folder.

    Lost executors cost nothing but a re-read: the files are outside every executor. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes them as soon as the result is no longer referenced.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it differ from all ``columns`` (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out

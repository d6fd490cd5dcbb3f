"""Sums and carried values along an order, without putting a group into one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's shared checkpoint folder; a temporary one only in local mode, where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="planframe-"))
    return df.checkpoint(eager=True)


#: Rows of the largest group that one task may sort for a plain window.
WINDOW_ROWS = 1_000_000


def fits_window(df: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than WINDOW_ROWS rows; one count a key, of the key columns alone."""
    if not keys:
        return df.count() <= WINDOW_ROWS
    largest = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= WINDOW_ROWS


def scan(df: DataFrame, keys: list[str], order: list[Column], values: list[str], how: str, names: list[str]) -> DataFrame:
    """Adds columns ``names``: the running sums of ``values`` per key in order, or their last values so far (``how``: sum, last).

    Where every group fits one task, this is a plain window. Otherwise rows are range-partitioned by key and order,
    so a key with many rows spans partitions; each partition is scanned alone, and what the earlier partitions of a
    key leave is added from one row a key and partition.
    """
    by = [F.col(k) for k in keys]
    if fits_window(df, keys):
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.coalesce(F.sum(v).over(whole), F.lit(0.0)) if how == "sum" else F.last(v, ignorenulls=True).over(whole) for n, v in zip(names, values)})
    placed = checkpointed(df.repartitionByRange(*by, *order).withColumn("__pid", F.spark_partition_id()))
    inside = Window.partitionBy("__pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    some = range(len(values))
    if how == "sum":
        ends = placed.groupBy("__pid", *by).agg(*[F.sum(v).alias(f"__end{i}") for i, v in enumerate(values)])
        local, carried = [F.sum(v).over(inside) for v in values], [F.sum(f"__end{i}").over(before) for i in some]
        join = [F.coalesce(F.col(f"__local{i}"), F.lit(0.0)) + F.coalesce(F.col(f"__carried{i}"), F.lit(0.0)) for i in some]
    else:
        place = F.row_number().over(Window.partitionBy("__pid", *by).orderBy(*order))
        ends = placed.withColumn("__at", place).groupBy("__pid", *by).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("__at"))).alias(f"__end{i}") for i, v in enumerate(values)])
        local, carried = [F.last(v, ignorenulls=True).over(inside) for v in values], [F.last(f"__end{i}", ignorenulls=True).over(before) for i in some]
        join = [F.coalesce(f"__local{i}", f"__carried{i}") for i in some]
    offsets = ends.withColumns({f"__carried{i}": c for i, c in enumerate(carried)}).select(F.col("__pid").alias("__from"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__carried{i}" for i in some])
    here = placed.withColumns({f"__local{i}": c for i, c in enumerate(local)})
    on = F.col("__pid") == F.col("__from")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = here.join(offsets, on, "left").withColumns(dict(zip(names, join)))
    return out.drop("__pid", "__from", *[f"__local{i}" for i in some], *[f"__carried{i}" for i in some], *[f"__k{i}" for i in range(len(keys))])

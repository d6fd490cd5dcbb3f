"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Rows of a key that stay together, and keys that are spread at most (those with the most rows; their list is broadcast).
TOGETHER = 1000
MOST_SPREAD = 1_000_000


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (at most a row a key) by ``key``: the rows of a frequent key, NULL among them, are dealt over several
    parts, and the row of that key in ``small`` is copied to each."""
    counted = big.groupBy(F.col(key).alias("hub")).agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER)
    hubs = materialise(counted.orderBy(F.desc("n")).limit(MOST_SPREAD).select("hub", F.ceil(F.col("n") / TOGETHER).cast("int").alias("parts")))
    if hubs.isEmpty():
        return big.join(small, key, how)
    known, parts = F.broadcast(hubs), F.coalesce("parts", F.lit(1))
    dealt = big.join(known, F.col(key).eqNullSafe(F.col("hub")), "left").withColumn("salt", F.pmod(F.xxhash64(*big.columns), parts).cast("int")).drop("hub", "parts")
    copied = small.join(known, F.col(key) == F.col("hub"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("hub", "parts")
    return dealt.join(copied, [key, "salt"], how).drop("salt")

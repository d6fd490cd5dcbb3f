"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``slots`` equal slots. Each shard owns ``virtual_nodes`` points, and a slot belongs to the
shard of the next point clockwise. A document lies in the slot of its text's hash, so equal texts lie together. A
shard may hold at most ``(1 + slack)`` times the mean number of bytes: walking the ring, what does not fit a
shard continues clockwise to the next point whose shard has room. Adding a shard moves what its
points take over and what overflows differently, and nothing else.

Scale. The walk looks at ``slots`` totals on the driver. Inside a slot, documents are ordered by (salt, doc_id, ...),
with the salt from the doc_id: offsets are running sums over the salts of a slot plus running
sums inside one (slot, salt) bucket. The number of salts follows the rows (``bucket_rows`` each if one text had them all), so a text that a third
of all rows share is spread at any size. Rows with equal doc_id and text, null ids among them, are counted before they are placed, and
so take one row each in these sums however often they occur. A slot that overflows is cut by offset. Positions inside a shard are counted
likewise: within buckets, and by running sums over the buckets of a slot and the slots of a shard.

Defined results. Null text: size 1, crc 0, same as the empty text. Repeated rows, and rows without doc_id: separate positions. Ties of hashes: ordered by
doc_id. Very long text: one row, wherever it fits by its first byte. Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, text_or_empty


def _hash(value: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(value.encode()).digest()[:8], "big")


def owners(shards: int, virtual_nodes: int, slots: int) -> list[list[int]]:
    """For each slot, the shards in the order in which they are met clockwise."""
    points = sorted((_hash(f"shard {s} point {v}") % slots, _hash(f"{v} of {s}"), s) for s in range(shards) for v in range(virtual_nodes))
    ring = [s for _, _, s in points]
    places = [p for p, _, _ in points]
    out, at = [], 0
    for slot in range(slots):
        while at < len(places) and places[at] < slot:
            at += 1
        seen: dict[int, None] = {}
        for k in range(len(ring)):
            seen.setdefault(ring[(at + k) % len(ring)], None)
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def walk(loads: list[int], clockwise: list[list[int]], shards: int, slack: float) -> list[list[tuple[int, int]]]:
    """For each slot, (first offset, shard) of its pieces."""
    room = [math.ceil((1 + slack) * sum(loads) / shards)] * shards
    pieces = []
    for load, order in zip(loads, clockwise):
        own, done = [], 0
        for shard in order:
            if done < load and room[shard] > 0:
                take = min(room[shard], load - done)
                own.append((done, shard))
                room[shard] -= take
                done += take
        pieces.append(own or [(0, order[0])])
    return pieces


def assign(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slots: int = 1024, bucket_rows: int = 1_000_000, slack: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position in the shard) for every row."""
    text = text_or_empty(docs)
    key = F.xxhash64(text)
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), key.alias("text_key"))
    counted = materialise(rows.groupBy("doc_id", "size", "text_crc32", "text_key").agg(F.count("*").alias("times")))
    salts = max(64, -(-counted.count() // bucket_rows))
    facts = counted.select("*", F.pmod("text_key", F.lit(slots)).cast("int").alias("place"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(salts)).cast("int").alias("salt"))
    bucket = materialise(facts.groupBy("place", "salt").agg(F.sum(F.col("size") * F.col("times")).alias("bytes")))
    loads = [0] * slots
    for place, n in bucket.groupBy("place").agg(F.sum("bytes")).collect():  # ``slots`` rows at most
        loads[place] = n
    pieces = walk(loads, owners(shards, virtual_nodes, slots), shards, slack)
    # (place, first offset, shard), at most slots * shards pieces, as a literal
    begins = F.array(*[F.array(*[F.lit(int(a)).cast("long") for a, _ in own]) for own in pieces])
    shard_of = F.array(*[F.array(*[F.lit(s) for _, s in own]) for own in pieces])
    before = F.sum("bytes").over(Window.partitionBy("place").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bucket.select("place", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("place", "salt").orderBy("doc_id", "text_key")
    inside = facts.withColumn("mine", F.sum(F.col("size") * F.col("times")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("times"))
    first = inside.join(offsets, ["place", "salt"]).withColumn("offset", F.col("before") + F.col("mine"))
    # equal rows lie one behind the other: those that begin inside a piece of the slot go to its shard
    own, next_own = F.get(begins, F.col("place")), F.get(shard_of, F.col("place"))
    upto = lambda end: F.greatest(F.lit(0), F.least(F.col("times"), F.ceil((end - F.col("offset")) / F.col("size").cast("double"))))
    runs = F.transform(own, lambda a, i: F.struct(F.get(next_own, i).alias("shard"), upto(a).alias("from"), F.coalesce(upto(F.get(own, i + 1)), F.col("times")).alias("to")))
    sharded = first.withColumn("run", F.explode(F.filter(runs, lambda r: r["to"] > r["from"]))).withColumn("shard", F.col("run.shard")).withColumn("n", F.col("run.to") - F.col("run.from"))
    within = Window.partitionBy("place", "salt", "shard").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    ranked = materialise(sharded.select("doc_id", "size", "text_crc32", "place", "salt", "shard", "n", (F.sum("n").over(within) - F.col("n")).alias("rank")))
    sizes = ranked.groupBy("shard", "place", "salt").agg(F.sum("n").alias("n"))
    # running sums over buckets: first over the places of a shard, then over the salts of a place
    by_place = sizes.groupBy("shard", "place").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "place").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "place", "salt", near.alias("near")).join(by_place.select("shard", "place", ahead.alias("ahead")), ["shard", "place"]).select("shard", "place", "salt", (F.col("ahead") + F.col("near")).alias("start"))
    placed = ranked.join(starts, ["shard", "place", "salt"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank") + F.col("copy")).cast("long").alias("slot"))

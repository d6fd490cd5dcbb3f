"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power ``exponent``, normalised. The exponent is found by
bisection (each round tries 33 exponents in one job, so five rounds narrow it to 3e-8): either the
largest at which the entropy of the weights reaches ``target_entropy``, or the smallest at which no source
is repeated more than ``max_repeats`` times. The budget defaults to the least number of tokens that uses every document once.

Realisation. Documents of a source fall into blocks by hash. An epoch is a permutation of the blocks, and
of the documents in each block, keyed by epoch and seed. A source with quota q and T tokens gives
``floor(q / T)`` whole epochs; the last one stops at its budget: whole blocks in order of the
permutation, then documents of one block in order while they fit. Running sums go over blocks (``blocks`` rows a source), then over
1,024 parts of the one block where the budget ends, and only one such part, a millionth of a source, is looked at row by row.

DataFrame operations only; the driver sees one row an exponent.

Defined results. Null source: a source of its own. Null or blank text: no tokens; such a row is used with
its block. A source without tokens is used once. Repeated rows: each mixed, all or none of them in the last epoch. Very long texts: counted whole. Ties of
hashes: used together or not at all. Empty table: no rows. Other columns, whatever their names, are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh, materialise, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
#: An ending block is cut into this power of two of parts, of which one is looked at row by row.
PART_BITS = 10


def _curves(shares: DataFrame, exponents: list[float]) -> list:
    """exponent, log of the sum of p**a, entropy, log of the largest and smallest p**(a - 1); one row an exponent."""
    each = shares.withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in exponents])))
    power = F.exp(F.col("a") * F.col("log_p"))
    tilt = (F.col("a") - 1) * F.col("log_p")
    z, zl = F.sum(power), F.sum(power * F.col("log_p"))
    return each.groupBy("a").agg(F.log(z).alias("log_z"), (F.log(z) - F.col("a") * zl / z).alias("entropy"), F.max(tilt).alias("high"), F.min(tilt).alias("low")).orderBy("a").collect()


def find_exponent(shares: DataFrame, total: float, target_entropy: float | None, max_repeats: float | None, budget: float | None, rounds: int = 5) -> float:
    """``shares``: log_p of every source with tokens."""
    low, high = 0.0, 1.0

    def fits(row) -> bool:  # holds for all exponents from some exponent on (repeats), or up to one (entropy)
        if target_entropy is not None:
            return row["entropy"] < target_entropy - 1e-12
        lead = math.log(budget / total) + row["high"] - row["log_z"] if budget else row["high"] - row["low"]
        return lead <= math.log(max_repeats) + 1e-12

    for _ in range(rounds):
        tried = _curves(shares, [low + (high - low) * i / 32 for i in range(33)])
        first = next((i for i, row in enumerate(tried) if fits(row)), None)
        if first is None:
            return tried[-1]["a"]
        if first == 0:
            return tried[0]["a"]
        low, high = tried[first - 1]["a"], tried[first]["a"]
    return round(low if target_entropy is not None else high, 6)


def plan(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, blocks: int = 1024, seed: int = 0, broadcast_rows: int = 1_000_000) -> tuple[Column, Column, Column, DataFrame]:
    """Columns of ``docs`` for the source, block and key of a row, and per (source, block): whole epochs, share of the last one, cut inside the block."""
    text = text_or_empty(docs)
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text))
    block = F.pmod(key, F.lit(blocks)).cast("int")
    source = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce(F.col("source").cast("string"), F.lit("")))
    # words are counted once a document
    narrow = materialise(docs.select(source.alias("_source"), block.alias("_block"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_tokens"), key.alias("_key")))
    by_block = materialise(narrow.groupBy("_source", "_block").agg(F.sum("_tokens").alias("t")))
    by_source = by_block.groupBy("_source").agg(F.sum("t").alias("total"))
    total = by_source.agg(F.sum("total")).first()[0] or 0
    shares = materialise(by_source.filter("total > 0").select("_source", "total", (F.log("total") - F.log(F.lit(float(max(1, total))))).alias("log_p")))
    if not total:
        exponent, log_scale = 1.0, 0.0
    else:
        exponent = find_exponent(shares, float(total), target_entropy, max_repeats, budget)
        row = _curves(shares, [exponent])[0]
        # the log of quota / total tokens of a source is log_scale + (exponent - 1) * log_p
        log_scale = math.log(budget / total) - row["log_z"] if budget else -row["low"]
        log_scale = round(log_scale, 9)
    repeats = F.round(F.exp(F.lit(log_scale) + F.lit(exponent - 1) * F.col("log_p")), 9)
    quota = shares.withColumn("repeats", repeats).select("_source", F.floor("repeats").alias("_whole"), F.floor((F.col("repeats") - F.floor("repeats")) * F.col("total")).alias("rest"))
    # a source without tokens is used once
    state = by_block.join(quota, "_source", "left").withColumn("_whole", F.coalesce("_whole", F.lit(1))).withColumn("rest", F.coalesce("rest", F.lit(0)))
    placed = materialise(_ends(state.withColumn("at", F.xxhash64(F.lit(seed), F.col("_whole"), F.col("_block"))).withColumn("tie", F.col("_block"))))
    bounded = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    ending = placed.filter("_share = 1").select("_source", "_block", "_whole", "rest")  # a block a source
    # inside that block again: parts of its order first, then the rows of the part where the budget ends
    order = F.xxhash64(F.col("_whole"), F.col("_key"))
    inside = narrow.join(bounded(ending), ["_source", "_block"]).withColumn("_order", order).withColumn("part", F.shiftright("_order", 64 - PART_BITS))
    parts = materialise(_ends(inside.groupBy("_source", "_block", "_whole", "rest", "part").agg(F.sum("_tokens").alias("t")).withColumn("at", F.col("part")).withColumn("tie", F.col("part"))))
    last = parts.filter("_share = 1").select("_source", "part", F.col("rest").alias("_left"))
    rows = inside.drop("rest").join(bounded(last), ["_source", "part"])
    running = F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_order").rangeBetween(Window.unboundedPreceding, 0))
    fits = rows.withColumn("upto", running).filter("upto <= _left").groupBy("_source").agg(F.max("_order").alias("_cut"))
    # where no row of that part fits, the cut is behind the last part that is taken whole
    full = parts.filter("_share = 2").groupBy("_source").agg((F.shiftleft(F.max("part"), 64 - PART_BITS) + F.lit((1 << 64 - PART_BITS) - 1)).alias("_full"))
    cuts = ending.select("_source").join(full, "_source", "left").join(fits, "_source", "left").select("_source", F.coalesce("_cut", "_full").alias("_cut"))
    known = placed.join(cuts, "_source", "left").select("_source", "_block", F.col("_whole").cast("int").alias("_whole"), "_share", F.when(F.col("_share") == 1, F.coalesce("_cut", F.lit(-(2**63)))).alias("_cut"))
    return source, block, key, known


def _ends(pieces: DataFrame) -> DataFrame:
    """Pieces (t tokens each) of a source in order: _share 2 where the budget ``rest`` takes the piece whole, 1 where it ends inside
    (``rest`` is then what is left for the piece), 0 behind."""
    order = Window.partitionBy("_source").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = pieces.withColumn("upto", F.sum("t").over(order))
    left = F.col("rest") - F.col("upto") + F.col("t")
    share = F.when(F.col("rest") <= 0, 0).when(F.col("upto") <= F.col("rest"), 2).when(left > 0, 1).otherwise(0)
    return summed.withColumn("_share", share).withColumn("rest", left).drop("at", "tie", "upto")


def mix(docs: DataFrame, seed: int = 0, blocks: int = 1024, broadcast_rows: int = 1_000_000, **parameters) -> DataFrame:
    """Rows of ``docs`` as often as the mixture uses them, with columns ``n_tokens``, ``epoch``, ``block_rank`` and ``in_block``:
    ordering by the last three within a source gives its permutations. Where ``docs`` has such a column, ours gets underscores in front."""
    source, block, key, known = plan(docs, seed=seed, blocks=blocks, broadcast_rows=broadcast_rows, **parameters)
    known = materialise(known)
    names = fresh(docs.columns, "mix_source", "mix_block", "mix_key", "mix_whole", "mix_share", "mix_cut", "mix_epoch")
    s, b, k, whole, share, cut, e = names
    table = known.select(*[F.col(a).alias(n) for a, n in zip(("_source", "_block", "_whole", "_share", "_cut"), (s, b, whole, share, cut))])
    joined = docs.select("*", source.alias(s), block.alias(b), key.alias(k)).join(F.broadcast(table) if known.count() <= broadcast_rows else table, [s, b])
    partial = (F.col(share) == 2) | ((F.col(share) == 1) & (F.xxhash64(F.col(whole).cast("long"), F.col(k)) <= F.col(cut)))
    times = F.col(whole) + F.when(partial, 1).otherwise(0)
    used = joined.filter(times > 0).withColumn(e, F.explode(F.sequence(F.lit(0), times - 1)))
    made = [F.regexp_count(text_or_empty(docs), F.lit(WORD)).cast("long"), F.col(e).cast("int"), F.xxhash64(F.lit(seed), F.col(e).cast("long"), F.col(b)), F.xxhash64(F.col(e).cast("long"), F.col(k))]
    own = fresh(docs.columns, "n_tokens", "epoch", "block_rank", "in_block")
    return used.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(made, own)])

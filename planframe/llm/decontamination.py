"""Benchmark decontamination: training windows looked up in a hash set of normalised test n-grams.

Words are runs outside ASCII punctuation and white space, with A-Z lower-cased. Each benchmark item
gives its windows of ``n`` consecutive words (a shorter item is one window). Every window is filed under its
longest word, the anchor, and the place of the anchor in it. The words of each document are scanned
against the broadcast anchors; a hit proposes at most ``n`` windows, whose words are then compared
whole with the broadcast windows. Both tables are broadcast only up to ``broadcast_windows`` windows of ``broadcast_bytes`` bytes;
beyond, single words meet the anchors in a shuffled join, and only documents with proposals are read again to compare
whole windows, so no row ever carries a whole text beside one word.

DataFrame operations only. Only proposals leave the scan; nothing is emitted per word or per pair.

Defined results. Null or blank text: no words, not contaminated. Null item text: no windows. Repeated
rows: judged each. Empty benchmark: nothing is contaminated. An item with a null id marks words but is
not listed among the items. Very long texts: scanned whole. Other columns of ``docs``, whatever their names, are ignored by
``report`` and kept by ``drop_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, materialise, text_or_empty

#: Fixed value: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, n: int) -> DataFrame:
    """grams (words joined by a space), length, anchor, place, items."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), split_words(fold(text_or_empty(benchmark))).alias("words")).filter(F.size("words") > 0)
    sized = words.withColumn("length", F.least(F.size("words"), F.lit(n)))
    each = sized.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)))
    cut = each.select("item_id", "length", F.slice("words", F.col("start"), F.col("length")).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("size"), (-i).alias("back"))))
    named = cut.select("item_id", "length", F.array_join("gram", " ").alias("grams"), "gram", (-longest["back"]).alias("place"))
    named = named.withColumn("anchor", F.lower(F.get("gram", F.col("place"))))
    return named.groupBy("grams", "length", "anchor", "place").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 1_000_000, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """One row a distinct (doc_id, text_key) with a hit: spans (start, end; in words) and items."""
    known = materialise(windows(benchmark, n))
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("grams") + F.octet_length("anchor") + 64), F.lit(0))).first()
    bounded = size[0] <= broadcast_windows and size[1] <= broadcast_bytes
    small = F.broadcast if bounded else (lambda df: df)
    anchors = small(known.groupBy("anchor").agg(F.collect_set(F.struct("place", "length")).alias("shapes")))
    text = text_or_empty(docs)
    scanned = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_key"), split_words(text).alias("words"))
    start, length = F.col("at") - F.col("shape.place"), F.col("shape.length")
    if bounded:
        placed = scanned.select("doc_id", "text_key", "words", F.posexplode("words").alias("at", "word"))
        proposed = placed.withColumn("anchor", F.lower("word")).join(anchors, "anchor").withColumn("shape", F.explode("shapes"))
        proposed = proposed.select("doc_id", "text_key", "words", start.alias("start"), length.alias("length"))
    else:
        placed = scanned.select("doc_id", "text_key", F.posexplode("words").alias("at", "word")).withColumn("anchor", F.lower("word")).drop("word")
        met = placed.join(anchors, "anchor").withColumn("shape", F.explode("shapes")).select("doc_id", "text_key", start.alias("start"), length.alias("length"))
        each = met.filter("start >= 0").groupBy(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key")).agg(F.collect_set(F.struct("start", "length")).alias("met"))
        back = scanned.join(each, scanned.doc_id.eqNullSafe(F.col("met_id")) & (scanned.text_key == F.col("met_key")))
        proposed = back.select("doc_id", "text_key", "words", F.inline("met"))
    start, length = F.col("start"), F.col("length")
    whole = proposed.filter((start >= 0) & (start + length <= F.size("words"))).select(
        "doc_id", "text_key", start.alias("start"), (start + length).alias("end"), fold(F.array_join(F.slice("words", start + 1, length), " ")).alias("grams")
    )
    found = whole.join(small(known.groupBy("grams").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))), "grams")
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def covered(spans: Column) -> Column:
    """How many words lie in at least one span; spans come sorted."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row each row of ``docs``."""
    text = text_or_empty(docs)
    all_docs = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    found = hits(docs, benchmark, n, broadcast_windows).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_key", "hit_key")
    joined = all_docs.join(found, all_docs.doc_id.eqNullSafe(found.hit_id) & (all_docs.text_key == found.hit_key), "left")
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long")
    items = F.coalesce(F.array_sort("items"), F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def _beside(docs: DataFrame, benchmark: DataFrame, n: int, broadcast_windows: int) -> tuple[DataFrame, Column, str]:
    """The hits under names that ``docs`` does not have, the condition that joins them, and the name of their spans."""
    hit_id, hit_key, spans = fresh(docs.columns, "hit_id", "hit_key", "spans")
    found = hits(docs, benchmark, n, broadcast_windows).select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key), F.col("spans").alias(spans))
    return found, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64(text_or_empty(docs)) == F.col(hit_key)), spans


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    found, match, spans = _beside(docs, benchmark, n, broadcast_windows)
    return docs.join(found.drop(spans), match, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``docs`` with the words of all hits, and the gaps before them, cut out of their texts."""
    found, match, spans = _beside(docs, benchmark, n, broadcast_windows)
    text = F.col("text")
    gaps = F.split(text, WORD, -1)
    inside = lambda i: F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"]))
    kept = F.transform(split_words(text), lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(F.get(gaps, i), w)))
    cut = F.concat(F.array_join(kept, ""), F.element_at(gaps, -1))
    return docs.join(found, match, "left").select(*[F.when(F.col(spans).isNotNull(), cut).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])

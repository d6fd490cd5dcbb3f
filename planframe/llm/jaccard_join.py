"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word n-grams (five words, ASCII lower-cased, punctuation apart). Every
set starts in one root per run; a node passes each of its sets on to ``branches`` children named by a
sampled token of the set: the set's smallest token under a random order shared by the whole level, so two sets
follow each other with probability equal to their Jaccard similarity. A node of one set ends there; a
node of at most ``small`` sets, a node whose sets are alike on average, and a node at the last level
are joined by brute force; others are split again. Runs repeat with fresh orders until the expected
recall at the threshold, ``1 - (1 - p)**runs`` with p the chance of one run, reaches ``recall``.

Equal sets are one class from the start, so copies cost nothing. Brute force means: in blocks of at
most ``block`` sets against ``block`` sets, each pair of blocks its own task's work, the exact
similarity of every pair is computed. A pair met in several nodes counts in the node of smallest name
only, so links are counted exactly once without writing pairs down; from each block pair only one row a
class leaves: its links, and the smallest class it reaches there. Connected classes are found from these
stars by passing on the smallest label, with pointer jumping. Joins on copies, classes and hubs of stars spread frequent keys.

Defined results. Texts without a word form no links: each is its own class (class_id is its doc_id,
n_links 0). Fewer than n words: all its words are one n-gram. Repeated rows are copies of each other.
Null doc_id: a class_id may then be null. Ties of the smallest id: any row with it is first. Very long texts: whole sets. Empty table: no rows. Other
columns, whatever their names, are ignored by ``similar_documents`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .arrow import runs_of
from .joins import spread_join
from .storage import fresh, materialise, text_or_empty

LEVELS = 4


def chance(threshold: float, branches: int, levels: int = LEVELS) -> float:
    """The chance that one run brings a pair of that similarity together after ``levels`` splits.

    All nodes of a level share its orders, so however many nodes a pair has in common it passes a level once.
    """
    return (1 - (1 - threshold) ** branches) ** levels


def runs_for(recall: float, threshold: float, branches: int) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - chance(threshold, branches))))


def shingles(part: T.Buffers, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row and their rows, in order of (row, hash)."""
    found = T.words(part, T.PUNCTUATION, fold=True)
    counts = found.counts(part.rows)
    gram, row = T.ngrams(found, n)
    short = np.flatnonzero((counts > 0) & (counts < n))
    for r in short:
        own = found.hash[found.row == r]
        total = T.mix((own * T.powers(len(own) + 1)[1:]).sum(dtype=T.U64) + np.array([len(own)], T.U64))[0]
        gram, row = np.append(gram, total), np.append(row, r)
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], row[new]


def _by_row(part: T.Buffers, n: int):
    """Distinct n-grams; for the rows that have any: the row, where its n-grams begin, and its class key."""
    gram, row = shingles(part, n)
    if not len(gram):
        return gram, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, first, size = np.unique(row, return_index=True, return_counts=True)
    key = T.mix(np.add.reduceat(T.mix(gram + T.U64(7)), first) ^ T.mix(size.astype(T.U64))).view(np.int64)
    return gram, rows, first, key


def signatures(docs: DataFrame, n: int, orders: int, id_column: str = "doc_id", text_key: bool = False) -> DataFrame:
    """doc_id, text_key (null unless asked for), set_key (null: no words), n_set, and the smallest n-gram under each of ``orders`` orders."""
    seeds = T.mix(np.arange(1, orders + 1, dtype=np.uint64) * T.U64(0xD1B54A32D192ED03))

    def sign(batches):
        for batch in batches:
            for part in T.buffers(batch.column(1)):
                gram, rows, first, key = _by_row(part, n)
                keys, sizes, mins = np.zeros(part.rows, np.int64), np.zeros(part.rows, np.int64), np.zeros((part.rows, orders), np.int64)
                none = np.ones(part.rows, bool)
                if len(rows):
                    keys[rows], none[rows] = key, False
                    sizes[rows] = np.diff(np.append(first, len(gram)))
                    for j, seed in enumerate(seeds):
                        mins[rows, j] = np.minimum.reduceat(T.mix(gram ^ seed), first).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * orders), pa.array(mins.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, part.rows) for c in (0, 2)), pa.array(keys, mask=none), pa.array(sizes), lists], ["doc_id", "text_key", "set_key", "n_set", "mins"])

    text = text_or_empty(docs)
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), (F.xxhash64(text) if text_key else F.lit(None).cast("long")).alias("text_key"))
    return named.mapInArrow(sign, "doc_id long, text_key long, set_key long, n_set long, mins array<long>")


#: Bits of the filter of ids at most (16 MB): with more ids it lets more others pass, which costs work and changes nothing.
MOST_ID_BITS = 1 << 27


def id_filter(ids: DataFrame) -> np.ndarray:
    """Words of a Bloom filter of the first column's hashes, two bits each, put together on Spark; at most MOST_ID_BITS come to the driver."""
    n = ids.count()
    size = min(MOST_ID_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    h = F.xxhash64(ids.columns[0])
    at = ids.select(F.explode(F.array(h.bitwiseAND(size - 1), F.shiftrightunsigned(h, 32).bitwiseAND(size - 1))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("w")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return out


def _maybe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    size = len(words) << 6
    has = lambda at: (words[at >> 6] >> (at & 63)) & 1
    return (has(h & (size - 1)) & has((h >> 32) & (size - 1))).astype(bool)


def token_sets(docs: DataFrame, n: int, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, set_key, and the set as 48-bit hashes, packed; of the rows whose id is in ``ids``, and few others."""
    known = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def pack(batches):
        for batch in batches:
            batch = batch.filter(pa.array(_maybe(known.value, batch.column(2).to_numpy())))
            for part in T.buffers(batch.column(1)):
                gram, rows, first, key = _by_row(part, n)
                small = np.ascontiguousarray(gram).view(np.uint8).reshape(-1, 8)[:, 2:]
                ends = np.append(first, len(gram))
                packed = [small[ends[i] : ends[i + 1]].tobytes() for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows).take(pa.array(rows)), pa.array(key), pa.array(packed, pa.binary())], ["doc_id", "set_key", "tokens"])

    doc_id = F.col(id_column).cast("long")
    return docs.select(doc_id.alias("doc_id"), text_or_empty(docs).alias("text"), F.xxhash64(doc_id).alias("hash")).mapInArrow(pack, "doc_id long, set_key long, tokens binary")


def leaves(classes: DataFrame, runs: int, branches: int, small: int, alike: float) -> DataFrame:
    """set_key, node, n_sets: the nodes that are joined by brute force and the sets in them."""
    per_run = LEVELS * branches

    def children(df: DataFrame, level: int) -> DataFrame:
        place = F.col("run") * per_run + level * branches + F.col("branch")
        path = F.xxhash64("node", place, F.get("mins", place))
        return df.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1)))).withColumn("node", path).drop("branch")

    state = classes.select("set_key", "mins", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("node", F.col("run").cast("long"))
    out = []
    for level in range(LEVELS):
        last = level == LEVELS - 1
        here = children(state, level)
        # two paths may lead a set to one node only with equal names: once is enough
        counted = here.groupBy("node").agg(F.count("*").alias("n_sets")).filter("n_sets > 1")
        if not last:
            nxt = F.get("mins", F.col("run") * per_run + (level + 1) * branches)
            big = counted.filter(F.col("n_sets") > small)
            spread = here.join(big, "node").groupBy("node", nxt.alias("v")).agg(F.count("*").alias("c"), F.first("n_sets").alias("n_sets"))
            split = materialise(spread.groupBy("node").agg((F.sum(F.col("c") * F.col("c")) / F.first(F.col("n_sets") * F.col("n_sets"))).alias("likeness")).filter(F.col("likeness") < alike).select("node"))
            more = not split.isEmpty()
            counted = counted.join(split, "node", "left_anti") if more else counted
        out.append(here.join(counted, "node").select("set_key", "node", "n_sets"))
        if last or not more:
            break
        state = materialise(here.join(split, "node", "left_semi"))
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def _shared(tokens: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """How many tokens each two sets share."""
    n = len(tokens)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    every = np.concatenate(tokens)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    times = np.bincount(column)
    common = times > 1
    keep = common[column]
    column, owner = (np.cumsum(common) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(common.sum()), chunk):
        lo, hi = np.searchsorted(column, [a, a + chunk])
        x = np.zeros((n, min(chunk, int(common.sum()) - a)), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(T.U64)


def _join_block(table: pa.Table, threshold: float) -> tuple[np.ndarray, ...] | None:
    """Links inside one pair of blocks that belong to its node: keys, linked sets, linked rows, smallest key reached."""
    key = table.column("set_key").to_numpy()
    key, where = np.unique(key, return_index=True)
    if len(key) < 2:
        return None
    table = table.take(pa.array(where))
    tokens = [_unpack(x) for x in table.column("tokens").to_pylist()]
    size = np.array([len(t) for t in tokens], np.float32)
    weight = table.column("n_rows").to_numpy().astype(np.float64)
    node = table.column("node")[0].as_py()
    block, a, b = (table.column(k).to_numpy() for k in ("block", "a", "b"))
    shared = _shared(tokens)
    link = shared * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-3
    np.fill_diagonal(link, False)
    if a[0] != b[0]:
        link &= block[:, None] != block[None, :]
    if not link.any():
        return None
    # a pair that also meets in a node of smaller name counts there
    nodes = table.column("nodes").to_pylist()
    earlier = [[x for x in own if x < node] for own in nodes]
    names = np.array([x for own in earlier for x in own], np.int64)
    if len(names):
        whose = np.repeat(np.arange(len(key)), [len(x) for x in earlier])
        _, column = np.unique(names, return_inverse=True)
        e = np.zeros((len(key), column.max() + 1), np.float32)
        e[whose, column] = 1
        link &= (e @ e.T) < 0.5
    touched = link.any(axis=1)
    if not touched.any():
        return None
    sets = link.sum(axis=1)
    rows = link @ weight
    # the smallest key connected inside this block pair
    root = np.arange(len(key))
    while True:
        nearest = np.where(link, root[None, :], len(key)).min(axis=1)
        new = np.minimum(root, nearest)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return key[touched], sets[touched].astype(np.int64), np.rint(rows[touched]).astype(np.int64), key[root[touched]]


def links(classes: DataFrame, found: DataFrame, docs: DataFrame, n: int, threshold: float, block: int, id_column: str) -> DataFrame:
    """set_key, linked_sets, linked_rows, reach: one row a class and pair of blocks."""
    per_set = found.groupBy("set_key").agg(F.collect_list(F.struct("node", "n_sets")).alias("at"))
    members = materialise(per_set.join(classes.select("set_key", "first_id", "n_rows"), "set_key"))
    sets = token_sets(docs, n, members.select("first_id"), id_column)
    same = (members.set_key == sets.set_key) & members.first_id.eqNullSafe(sets.doc_id)
    placed = (
        members.join(sets, same)
        .select(members.set_key, "n_rows", "tokens", "at", F.col("at.node").alias("nodes"))
        .withColumn("here", F.explode("at"))
        .select("set_key", "n_rows", "tokens", "nodes", F.col("here.node").alias("node"), F.ceil(F.col("here.n_sets") / block).cast("int").alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("set_key", "n_rows", "tokens", "nodes", "node", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    )

    def join(batches):
        for table in runs_of(batches, ["node", "a", "b"]):
            if (got := _join_block(table, threshold)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["set_key", "linked_sets", "linked_rows", "reach"])

    return placed.repartition("node", "a", "b").sortWithinPartitions("node", "a", "b").mapInArrow(join, "set_key long, linked_sets long, linked_rows long, reach long")


def components(edges: DataFrame, a: str = "set_key", b: str = "reach") -> DataFrame:
    """key, label: the smallest key connected to each key that has an edge."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    both = materialise(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        near = spread_join(both, labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        stepped = materialise(labels.join(near, "u").select("u", "label", F.least("label", "near").alias("next")))
        jump = stepped.select(F.col("u").alias("next"), F.col("next").alias("far"))
        new = materialise(spread_join(stepped, jump, "next").select("u", "label", F.least("next", "far").alias("next")))
        if new.filter("label <> next").isEmpty():
            return new.select(F.col("u").alias("key"), "label")
        labels = new.select("u", F.col("next").alias("label"))


def _labelled(docs: DataFrame, text_key: bool, n: int = 5, threshold: float = 0.8, recall: float = 0.99, branches: int = 2, small: int = 1024, block: int = 1024, alike: float = 0.5, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set_key; sets with their label (equal for all sets that links connect), first_id and n_rows; links of sets."""
    runs = runs_for(recall, threshold, branches)
    signed = materialise(signatures(docs, n, runs * LEVELS * branches, id_column, text_key))
    classes = materialise(signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.any_value("mins").alias("mins")))
    found = materialise(leaves(classes, runs, branches, small, alike))
    edges = materialise(links(classes, found, docs, n, threshold, block, id_column))
    label = components(edges).withColumnRenamed("key", "set_key")
    named = classes.select("set_key", "first_id", "n_rows").join(label, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    return signed, named, edges


def similar_documents(docs: DataFrame, **parameters) -> DataFrame:
    """One row a document: doc_id, class_id (smallest doc_id connected by links), n_links (other rows of
    similarity at least ``threshold``, copies among them), n_linked_texts (other sets so linked),
    n_copies (rows with the same set), is_first (the row whose doc_id is class_id).

    ``parameters``: n, threshold, recall, branches, small, block, alike, id_column, as in the module's description."""
    signed, named, edges = _labelled(docs, False, **parameters)
    counts = edges.groupBy("set_key").agg(F.sum("linked_sets").alias("linked_sets"), F.sum("linked_rows").alias("linked_rows"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = spread_join(named, lowest, "label").join(counts, "set_key", "left").select(
        F.col("set_key"), "class_id", (F.coalesce("linked_rows", F.lit(0)) + F.col("n_rows") - 1).cast("long").alias("n_links"), F.coalesce("linked_sets", F.lit(0)).cast("long").alias("n_linked_texts"), F.col("n_rows").alias("n_copies")
    )
    return spread_join(signed.select("doc_id", "set_key"), named, "set_key", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_linked_texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.col("class_id").eqNullSafe(F.col("doc_id")), F.lit(True)).alias("is_first"),
    )


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each class: that of the smallest doc_id (null last), of equal ids that of the smallest hash of its text.

    A row is its (doc_id, text): rows that share a doc_id but belong to different classes are judged each. Of equal rows one stays.
    A row without a word stays as it is.
    """
    signed, named, _ = _labelled(docs, True, **parameters)
    rows = signed.filter("set_key is not null").groupBy("doc_id", "text_key", "set_key").agg(F.count("*").alias("times"))
    placed = spread_join(rows, named.select("set_key", "label"), "set_key").withColumn("place", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    best = placed.groupBy("label").agg(F.min("place").alias("best"))
    judged = materialise(spread_join(placed, best, "label").select("doc_id", "text_key", "times", (F.col("place") == F.col("best")).alias("stays")))
    row_id, row_key = fresh(docs.columns, "row_id", "row_key")
    match = F.col("doc_id").eqNullSafe(F.col(row_id)) & (F.xxhash64(text_or_empty(docs)) == F.col(row_key))
    of = lambda which: judged.filter(which).select(F.col("doc_id").alias(row_id), F.col("text_key").alias(row_key))
    # classes of equal rows: all but one of them go
    twice = of("stays and times > 1")
    if twice.isEmpty():
        return docs.join(of("not stays"), match, "left_anti")
    kept = docs.join(of("not stays or times > 1"), match, "left_anti")
    again = docs.join(twice, match, "left_semi").withColumns({row_id: F.col("doc_id"), row_key: F.xxhash64(text_or_empty(docs))}).dropDuplicates([row_id, row_key])
    return kept.unionByName(again.drop(row_id, row_key))

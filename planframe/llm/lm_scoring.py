"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs in the training documents are quantised on a logarithmic scale: a count c
gets the level ``1 + floor(log_base c)``, and the filter holds the n-gram with every level up to its own.
A reader probes level 1, 2, ... until a probe fails; the last level found gives the expected count, the middle
of the counts of that level. Probabilities are smoothed by interpolation: ``(1 - share) * (c(w) + 1) / (N + V + 1) +
share * c(v, w) / c(v)``, with every c out of the filter, each part at most 1; a word after an unknown
word has the first part alone. So no probability exceeds 1 and no score is positive.

Error. A level is never missed, so a count is never read below its level (a factor of ``base`` at most). It is read
too high only where all PROBES bits of the next level are set by others. Every segment of the filter is as long as its own
number of entries (n-grams times levels) demands, ``bits_per_entry`` each, whatever the input: with 8 bits and 3
probes a third of the bits are set at most, so one n-gram in 30 is read one level too high.

Scale. Tasks send sorted hashes with counts, packed by segment of the hash space; the number of segments follows the
bytes of training text, so the work of a segment does not grow. A filter of up to ``2**max_bits`` bits (8 MB, under the
size that Spark itself broadcasts) is broadcast whole; a larger one stays in its segments, and the distinct n-grams of each pack of documents are sent there,
probed, and their levels sent back to the pack. Both ways give the same scores, at any number of partitions. The exact word counts that the
baseline asks for are looked up in the same segments in the same round; no vocabulary is ever collected.

Defined results. Null or blank text: one token (the end). Repeated rows: scored each. Very long text: a pack of its
own. Empty table: no rows. Empty training part: N = V = 0 and every count 0. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .arrow import runs_of
from .storage import materialise, text_or_empty

END = T.mix(np.array([11], T.U64))[0]
BEGIN = T.mix(np.array([13], T.U64))[0]
_WORD, _PAIR = T.U64(0x5851F42D4C957F2D), T.U64(0x14057B7EF767814F)
PROBES = 3
TOP = 96
#: Bytes of training text whose n-grams share a segment, and bytes of text in a pack of documents.
SEGMENT_BYTES = 8 << 20
PACK_BYTES = 4 << 20
MOST_TASKS = 50_000
_LOW = T.U64((1 << 40) - 1)


def tokens(part: T.Buffers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all tokens, the end of each row included, in order."""
    found = T.words(part, T.WHITE, fold=True)
    counts = found.counts(part.rows)
    ends = np.cumsum(counts + 1) - 1
    hashes = np.empty(len(found.hash) + part.rows, T.U64)
    is_end = np.zeros(len(hashes), bool)
    is_end[ends] = True
    hashes[is_end], hashes[~is_end] = END, found.hash
    return hashes, np.repeat(np.arange(part.rows), counts + 1)


def previous(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    before = np.empty_like(hashes)
    before[:1] = BEGIN
    before[1:] = np.where(row[1:] == row[:-1], hashes[:-1], BEGIN)
    return before


def word_key(h: np.ndarray) -> np.ndarray:
    return T.mix(h ^ _WORD)


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(before ^ _PAIR) + h)


def home(key: np.ndarray, segments: int) -> np.ndarray:
    """The segment of each key, from its upper half; inside a segment the lower 40 bits name it."""
    return ((key >> T.U64(32)) % T.U64(segments)).astype(np.int64)


def short(key: np.ndarray) -> bytes:
    """The lower 40 bits of each key."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unshort(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view(T.U64)


def level_of(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def expected(base: float) -> np.ndarray:
    """The middle of the counts of each level; 0 for level 0."""
    edge = np.ceil(base ** np.arange(TOP + 1) - 1e-9)
    return np.concatenate([[0.0], (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2])


def positions(key: np.ndarray, level: int, size) -> list[np.ndarray]:
    """The bits of a key at a level, in a segment of ``size`` bits (one size, or one a key)."""
    h = T.mix((key & _LOW) ^ T.mix(np.array([level], T.U64) * T.U64(0xA0761D6478BD642F)))
    step = T.mix(h) | T.U64(1)
    return [(h + T.U64(i) * step) % size for i in range(PROBES)]


def set_bits(key: np.ndarray, level: np.ndarray, bits_per_entry: int) -> np.ndarray:
    """The packed bits of one segment."""
    size = max(64, -(-int(level.sum()) * bits_per_entry // 8) * 8)
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in positions(key[level >= j], j, T.U64(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Segments of bits, one behind the other."""

    def __init__(self, parts: dict[int, np.ndarray], segments: int):
        """``parts``: packed bits by segment; a segment without n-grams may lack."""
        self.sizes = np.array([8 * len(parts.get(s, ())) for s in range(segments)], T.U64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bits = np.concatenate([np.zeros(0, np.uint8), *[parts[s] for s in sorted(parts)]])
        self.segments = segments

    def level(self, key: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
        """The last level found, by probing one level after another."""
        level = np.zeros(len(key), np.int64)
        if segment is None:
            segment = home(key, self.segments)
        alive = np.flatnonzero(self.sizes[segment] > 0)
        for j in range(1, TOP + 1):
            where = segment[alive]
            found = np.ones(len(alive), bool)
            for at in positions(key[alive], j, self.sizes[where]):
                at = at + self.first[where]
                found &= ((self.bits[at >> T.U64(3)] >> (at & T.U64(7)).astype(np.uint8)) & 1).astype(bool)
            alive = alive[found]
            if not len(alive):
                break
            level[alive] = j
        return level


def in_segments(key: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings the keys into their segments, and where each segment begins."""
    at = home(key, segments)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(segments + 1))


def keys_of(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all words and of all pairs, sorted."""
    words, pairs = [np.zeros(0, T.U64)], [np.zeros(0, T.U64)]
    for h, row in found:
        words.append(word_key(np.unique(h)))
        pairs.append(np.unique(pair_key(previous(h, row), h)))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def gather(training: DataFrame, segments: int, flush: int = 2_500_000) -> DataFrame:
    """segment, is_word, keys, counts: packed counts of each task, a few rows a segment."""

    def count(batches):
        held = {True: ([], []), False: ([], [])}
        size = 0

        def out():
            for is_word, (keys, counts) in held.items():
                if not keys:
                    continue
                key, number = _merge(keys, counts)
                order, cut = in_segments(key, segments)
                key, number = key[order], number[order].astype(np.uint32)
                some = np.flatnonzero(cut[1:] > cut[:-1])
                pack = (lambda k: k.tobytes()) if is_word else short
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([is_word] * len(some), pa.bool_()), pa.array([pack(key[cut[s] : cut[s + 1]]) for s in some], pa.binary()), pa.array([zlib.compress(number[cut[s] : cut[s + 1]].tobytes(), 1) for s in some], pa.binary())],
                    ["segment", "is_word", "keys", "counts"],
                )
                held[is_word] = ([], [])

        for batch in batches:
            for part in T.buffers(batch.column(0), 1 << 20):
                h, row = tokens(part)
                for is_word, key in ((True, word_key(h)), (False, pair_key(previous(h, row), h))):
                    key, number = np.unique(key, return_counts=True)
                    held[is_word][0].append(key)
                    held[is_word][1].append(number)
                    size += len(key)
                if size > flush:
                    yield from out()
                    size = 0
        yield from out()

    return training.select("text").mapInArrow(count, "segment int, is_word boolean, keys binary, counts binary")


def to_segments(df: DataFrame, segments: int, *order: str) -> DataFrame:
    """Rows at the task of their segment, a task for each up to MOST_TASKS, in order of segments."""
    tasks = min(segments, MOST_TASKS)
    return df.repartitionById(tasks, F.pmod("segment", F.lit(tasks))).sortWithinPartitions("segment", *order)


def _packed(table: pa.Table, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """All counts of the words, or of the pairs, of one segment."""
    keys, counts = [np.zeros(0, T.U64)], [np.zeros(0, np.int64)]
    for is_word, k, c in zip(*(table.column(n).to_pylist() for n in ("is_word", "keys", "counts"))):
        if is_word == words:
            keys.append(np.frombuffer(k, T.U64) if words else unshort(k))
            counts.append(np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64))
    return _merge(keys, counts)


def train(docs: DataFrame, base: float, bits_per_entry: int) -> tuple[DataFrame, dict, int]:
    """Per segment: its bits, its words and their counts. And what is known of the whole."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    segments = max(1, -(-int(size) // SEGMENT_BYTES))

    def build(batches):
        for table in runs_of(batches, ["segment"]):
            word, number = _packed(table, True)
            pair, times = _packed(table, False)
            bits = set_bits(np.concatenate([word, pair]), level_of(np.concatenate([number, times]), base), bits_per_entry)
            yield pa.RecordBatch.from_arrays(
                [pa.array([table.column("segment")[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([word.tobytes()], pa.binary()), pa.array([zlib.compress(number.tobytes(), 1)], pa.binary()), pa.array([int(number.sum())]), pa.array([len(word)])],
                ["segment", "bits", "words", "counts", "n", "v"],
            )

    packed = to_segments(gather(docs, segments), segments)
    built = materialise(packed.mapInArrow(build, "segment int, bits binary, words binary, counts binary, n long, v long"))
    n, v, size = built.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("n"), F.col("v"), F.octet_length("bits"))]).first()
    return built, {"N": int(n), "V": int(v), "D": int(rows), "bytes": int(size)}, segments


def packs(docs: DataFrame) -> DataFrame:
    """part, data: consecutive rows of about PACK_BYTES of text as one compressed Arrow stream."""

    def pack(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for batch in held:
                    stream.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "data"])

        for batch in batches:
            for some in T.buffers(batch.column(batch.schema.get_field_index("text")), PACK_BYTES // 4):
                held.append(batch.slice(some.first, some.rows))
                size += len(some.data)
                if size >= PACK_BYTES:
                    yield out()
                    part, held, size = part + 1, [], 0
        if held:
            yield out()

    return docs.mapInArrow(pack, "part long, data binary")


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def ask(placed: DataFrame, segments: int, pairs_too: bool) -> DataFrame:
    """segment, part, words, pairs: the distinct keys of each pack, by segment."""

    def keys(batches):
        for batch in batches:
            for part, data in zip(*(c.to_pylist() for c in batch.columns)):
                words, pairs = keys_of([tokens(x) for x in T.buffers(unpack(data).column("text"), 1 << 20)])
                pairs = pairs if pairs_too else pairs[:0]
                (a, cut_a), (b, cut_b) = in_segments(words, segments), in_segments(pairs, segments)
                words, pairs = words[a], pairs[b]
                some = np.flatnonzero((cut_a[1:] > cut_a[:-1]) | (cut_b[1:] > cut_b[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([part] * len(some), pa.int64()), pa.array([words[cut_a[s] : cut_a[s + 1]].tobytes() for s in some], pa.binary()), pa.array([short(pairs[cut_b[s] : cut_b[s + 1]]) for s in some], pa.binary())],
                    ["segment", "part", "words", "pairs"],
                )

    return placed.mapInArrow(keys, "segment int, part long, words binary, pairs binary")


def answer(asked: DataFrame, built: DataFrame, segments: int, with_filter: bool) -> DataFrame:
    """part, segment, counts, levels: exact counts of the words, and levels of words and pairs (``with_filter``)."""
    own = built.select("segment", F.lit(-1).cast("long").alias("part"), "words", F.col("bits").alias("pairs"), "counts")

    def probe(batches):
        """In each segment its bits and words come first, then the keys of one pack after another."""
        here, model, known, counts = None, None, None, None
        for batch in batches:
            out = []
            for segment, part, words, pairs, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    here, model = segment, Filter({0: np.frombuffer(pairs, np.uint8)}, 1) if with_filter else None
                    known, counts = np.frombuffer(words, T.U64), np.frombuffer(zlib.decompress(packed), np.int64)
                    continue
                if segment != here:
                    here, model, known, counts = segment, None, np.zeros(0, T.U64), np.zeros(0, np.int64)
                word, pair = np.frombuffer(words, T.U64), unshort(pairs)
                found = np.zeros(len(word), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    found = np.where(known[at] == word, counts[at], 0)
                key = np.concatenate([word, pair]) if with_filter else pair
                level = model.level(key, np.zeros(len(key), np.int64)) if model else np.zeros(len(key), np.int64)
                out.append((part, segment, zlib.compress(found.tobytes(), 1), zlib.compress(level.astype(np.uint8).tobytes(), 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["part", "segment", "counts", "levels"])

    placed = to_segments(own.unionByName(asked, allowMissingColumns=True), segments, "part")
    return placed.mapInArrow(probe, "part long, segment int, counts binary, levels binary")


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7, share: float = 0.5, base: float = 1.5, bits_per_entry: int = 8, max_bits: int = 26) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"), (fold == held_out).alias("held_out"))
    built, known, segments = train(rows.filter(~F.col("held_out")), base, bits_per_entry)
    whole = 8 * known["bytes"] <= 1 << max_bits
    parts = {s: np.frombuffer(b, np.uint8) for s, b in built.select("segment", "bits").toLocalIterator()} if whole else {}  # 2**max_bits bits at most
    shared = spark.sparkContext.broadcast(Filter(parts, segments) if whole else None)
    n, total, starts = known["N"], known["N"] + known["V"] + 1, max(1, known["D"])
    middle = expected(base)

    def settle(pack: pa.Table, answers: pa.Table) -> pa.Table:
        docs = unpack(pack.column("data")[0].as_py())
        parts = [(x.rows, *tokens(x)) for x in T.buffers(docs.column("text"), 1 << 20)]
        words, pairs = keys_of([(h, row) for _, h, row in parts])
        (a, cut_a), (b, cut_b) = in_segments(words, segments), in_segments(pairs, segments)
        exact, word_level, pair_level = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
        for s, counts, levels in zip(*(answers.column(c).to_pylist() for c in ("segment", "counts", "levels"))):
            exact[a[cut_a[s] : cut_a[s + 1]]] = np.frombuffer(zlib.decompress(counts), np.int64)
            if not whole:
                level, many = np.frombuffer(zlib.decompress(levels), np.uint8), cut_a[s + 1] - cut_a[s]
                word_level[a[cut_a[s] : cut_a[s + 1]]] = level[:many]
                pair_level[b[cut_b[s] : cut_b[s + 1]]] = level[many:]
        if whole:
            word_level, pair_level = shared.value.level(words), shared.value.level(pairs)
        word_count, pair_count = middle[word_level], middle[pair_level]
        one = np.log10((exact + 1) / total)
        out = []
        for rows, h, row in parts:
            before = previous(h, row)
            at = np.searchsorted(words, word_key(h))
            pair = pair_count[np.searchsorted(pairs, pair_key(before, h))]
            context = np.empty(len(h))
            context[1:] = word_count[at[:-1]]
            context[before == BEGIN] = starts
            mixed = np.where(context > 0, share, 0)
            p = (1 - mixed) * np.minimum(1, (word_count[at] + 1) / total) + mixed * np.minimum(1, pair / np.maximum(context, 1))
            sums = lambda w: np.bincount(row, weights=w, minlength=rows)
            out.append((np.bincount(row, minlength=rows), sums(exact[at] > 0), sums(one[at]), sums(np.log10(p))))
        tokens_, found, plain, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": tokens_, "n_known": found.astype(np.int64), "train_tokens": np.full(len(tokens_), n), "base_score": plain, "score": score})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = packs(rows).repartition(tasks, "part")
    answers = answer(ask(placed, segments, not whole), built, segments, not whole).repartition(tasks, "part")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(settle, schema)

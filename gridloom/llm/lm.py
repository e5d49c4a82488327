"""Language-model scores from a log-frequency Bloom filter.

The filter holds no n-grams, only that "the count of g reached level j": an n-gram with count c is
entered with each level j up to ``1 + floor(log_base c)``. A lookup probes levels 1, 2, ... until one
is missing; false positives can only raise a count, and rarely by more than a level. Each n-gram's
probes stay inside one block of the filter, so blocks are built independently: the counts are
shuffled once, packed, to the segment that owns their block, and every segment is a bitmap.

A filter is broadcast up to ``max_filter_bytes``. One that has grown beyond stays in its segments: the
distinct n-grams of ``CHUNK_ROWS`` texts at a time are dealt to the segments that own their blocks, probed there
and sent back as one byte each, so a filter of any size takes one pass. Both ways probe the same
bits and give the same levels.

The model is a bigram with Dirichlet smoothing towards the unigram::

    p(w | h) = (c(h w) + mu * p(w)) / (c(h) + mu),  p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with every c read from the filter. The plain base score beside it needs exact counts: frequent words
come from a broadcast table of bounded size, all others from a join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, forget, id_fold, materialise, release, text_or_empty, word_hashes, words

#: The token behind each document; no word holds a space.
END = b" "
#: The history of a document's first token.
START = b"  "
BASE = 1.5
PROBES = 4
#: Bits of the filter for each training token; each adds less than one distinct n-gram on average.
BITS_PER_TOKEN = 6
BLOCK_BITS = 1 << 16
MAX_FILTER_BYTES = 96 << 20
MU = 2.0
#: Words in the broadcast table and their longest length: at most about 16 MB.
COMMON_WORDS = 1 << 17
COMMON_BYTES = 48
#: Tokens of a counting chunk, and n-grams that a segment is meant to hold.
CHUNK_TOKENS = 1 << 21
SEGMENT_GRAMS = 1 << 20
#: Texts whose distinct n-grams are looked up together in a filter that is not broadcast.
CHUNK_ROWS = 256

#: Levels a count can reach: 1.5 ** 100 is beyond 64 bits.
MAX_LEVEL = 100
#: The bits of a hash that tell n-grams apart in the filter; the low 16 are not shuffled.
KEPT = np.uint64(0xFFFFFFFFFFFF0000)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit hashes in order."""
    x = (a * _MIX) ^ (b + np.uint64(0x632BE59BD9B4E019))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's tokens with START before and END behind, and of its bigrams."""
    tokens = [START, *ws, END]
    h = np.fromiter(map(word_hashes.__getitem__, tokens), np.uint64, len(tokens))
    return h, mix(h[:-1], h[1:])


def levels(counts: np.ndarray, base: float = BASE) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def level_counts(level: np.ndarray, base: float = BASE) -> np.ndarray:
    """The count a level stands for: the middle of its range, 0 for level 0, 1 for level 1."""
    low = np.ceil(base ** np.maximum(level - 1.0, 0) - 1e-9)
    high = np.maximum(np.ceil(base ** np.maximum(level, 1.0) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each n-gram: equal ranges of the hash, so that segments are ranges of blocks."""
    return (h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)


def probes(h: np.ndarray, level: np.ndarray) -> Iterator[np.ndarray]:
    """Bit positions, within the n-gram's block, of the probes of (n-gram, level)."""
    x = mix(h, level.astype(np.uint64))
    for _ in range(PROBES):
        yield (x & np.uint64(BLOCK_BITS - 1)).astype(np.int64)
        x = x * _MIX + np.uint64(0x632BE59BD9B4E019)
        x ^= x >> np.uint64(31)


class Filter:
    """A bitmap of blocks [first, first + n) out of ``blocks``; it knows nothing of other n-grams."""

    def __init__(self, bits: np.ndarray, first: int, blocks: int) -> None:
        self.bits, self.first, self.blocks = bits, first, blocks

    def level(self, h: np.ndarray) -> np.ndarray:
        """The highest level of each n-gram up to which every probe is set; 0 for what others own."""
        h = h & KEPT
        out = np.zeros(len(h), np.int64)
        block = block_of(h, self.blocks).astype(np.int64) - self.first
        left = np.flatnonzero((block >= 0) & (block < len(self.bits) * 8 // BLOCK_BITS))
        for j in range(1, MAX_LEVEL):
            if not len(left):
                break
            base = block[left] * BLOCK_BITS
            ok = np.ones(len(left), bool)
            for at in probes(h[left], np.full(len(left), j)):
                at = base + at
                ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            left = left[ok]
            out[left] = j
        return out


def bitmap(h: np.ndarray, counts: np.ndarray, first: int, n_blocks: int, blocks: int) -> np.ndarray:
    """Bits of ``n_blocks`` blocks from ``first`` on, every n-gram entered with all its levels."""
    bits = np.zeros(n_blocks * BLOCK_BITS, bool)
    top, base = levels(counts), (block_of(h, blocks).astype(np.int64) - first) * BLOCK_BITS
    j = 1
    while len(h):
        for at in probes(h, np.full(len(h), j)):
            bits[base + at] = True
        j += 1
        keep = top >= j
        h, top, base = h[keep], top[keep], base[keep]
    return np.packbits(bits, bitorder="little")


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, n long): exact counts of the training tokens, END among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = iter(held.items())
            while part := list(islice(items, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                held.update(words(text))
                held[END] += 1
            if len(held) > 300_000:
                yield from out()
                held.clear()
        yield from out()

    return train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted 48-bit hashes (the low 16 bits are not kept) as differences of 4 bytes, or 8 where one is wider."""
    gaps = np.diff(h >> np.uint64(16), prepend=np.uint64(0))
    first = gaps[:1].astype("<u8").tobytes()
    rest = gaps[1:]
    return first + (rest.astype("<u4") if not len(rest) or int(rest.max()) < 1 << 32 else rest.astype("<u8")).tobytes()


def unpack_hashes(raw: bytes, n: int) -> np.ndarray:
    first = np.frombuffer(raw, "<u8", 1)
    rest = np.frombuffer(raw, "<u4" if len(raw) == 8 + 4 * (n - 1) else "<u8", n - 1, 8)
    return np.cumsum(np.concatenate([first, rest.astype(np.uint64)]), dtype=np.uint64) << np.uint64(16)


def packed_counts(train: DataFrame, segments: int, blocks: int) -> DataFrame:
    """(segment, hashes, counts): each chunk's distinct n-grams of a segment with their counts.

    Unigrams, bigrams and START are entered alike.
    """
    per = blocks // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) & KEPT, return_counts=True)
            cuts = np.searchsorted(block_of(h, blocks), np.arange(segments + 1, dtype=np.uint64) * np.uint64(per))
            which = np.flatnonzero(np.diff(cuts)).tolist()
            packed = [pack_hashes(h[cuts[s] : cuts[s + 1]]) for s in which]
            counts = [np.minimum(n[cuts[s] : cuts[s + 1]], 2**32 - 1).astype("<u4").tobytes() for s in which]
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], ["segment", "hashes", "counts"])

        size = 0
        for b in batches:
            for text in b.column("text").to_pylist():
                uni, bi = grams(words(text))
                held += [uni, bi]
                size += len(uni)
            if size >= CHUNK_TOKENS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return train.mapInArrow(run, "segment long, hashes binary, counts binary")


def segment_bitmaps(train: DataFrame, segments: int, blocks: int) -> DataFrame:
    """(segment, bits): the filter, one row per segment."""
    per = blocks // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, parts in zip(b.column("segment").to_pylist(), b.column("parts").to_pylist()):
                counts = [np.frombuffer(x["counts"], "<u4").astype(np.int64) for x in parts]
                h, inverse = np.unique(np.concatenate([unpack_hashes(x["hashes"], len(n)) for x, n in zip(parts, counts)]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
                bits = bitmap(h, total, segment * per, per, blocks)
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["segment", "bits"])

    packed = packed_counts(train, segments, blocks)
    return packed.groupBy("segment").agg(F.collect_list(F.struct("hashes", "counts")).alias("parts")).mapInArrow(run, "segment long, bits binary")


class Scorer:
    """What turns the levels of texts' n-grams into rows; ``common`` has the exact counts of frequent words."""

    NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_log", "score", "rare", "rare_n"]
    SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double, rare array<binary>, rare_n array<long>"

    def __init__(self, common, n_train: int, v_train: int, mu: float) -> None:
        self.common, self.n_train, self.v_train, self.mu = common, n_train, v_train, mu

    def rows(self, ids: list[pa.Array], texts: list[list[bytes]], h: np.ndarray, uni: np.ndarray, bi: np.ndarray) -> pa.RecordBatch:
        """``ids``: row, doc_id, held_out; h, uni, bi: hash and levels of each token (START before each text) and of the pair it ends."""
        tokens = [t for ws in texts for t in (START, *ws, END)]
        counts = level_counts(np.stack([uni, bi]).astype(np.float64))
        plain = (counts[0] + 0.1) / (self.n_train + 0.1 * (self.v_train + 1))
        history = np.concatenate([[0.0], counts[0][:-1]])
        model = np.log10((np.minimum(counts[1], history) + self.mu * plain) / (history + self.mu))
        keys, values = self.common.value
        place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        exact = np.where(keys[place] == h, values[place], 0) if len(keys) else np.zeros(len(h), np.int64)
        sizes = np.array([len(ws) + 2 for ws in texts])
        ends = np.cumsum(sizes)
        model[ends - sizes] = 0.0  # START is no token of the text
        exact[ends - sizes] = -1
        common_log = np.where(exact > 0, np.log10(np.maximum(exact, 1) + 0.1), 0.0)
        rare = [Counter([tokens[i] for i in (e - n + np.flatnonzero(exact[e - n : e] == 0)).tolist()]) for e, n in zip(ends.tolist(), sizes.tolist())]
        out = [
            *ids,
            pa.array(sizes - 1, pa.int64()),
            pa.array(np.add.reduceat(exact > 0, ends - sizes, dtype=np.int64), pa.int64()),
            pa.array(np.add.reduceat(common_log, ends - sizes), pa.float64()),
            pa.array(np.add.reduceat(model, ends - sizes), pa.float64()),
            pa.array([list(x) for x in rare], pa.list_(pa.binary())),
            pa.array([list(x.values()) for x in rare], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(out, self.NAMES)


def token_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """Hashes of all texts' tokens in a row, START before and END behind each text."""
    tokens = [t for ws in texts for t in (START, *ws, END)]
    return np.fromiter(map(word_hashes.__getitem__, tokens), np.uint64, len(tokens))


def by_broadcast(src: DataFrame, whole, scorer: Scorer) -> DataFrame:
    """Scored rows of (row, doc_id, held_out, text); ``whole`` is the broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        bound = whole.value
        for b in batches:
            texts = [words(x) for x in b.column("text").to_pylist()]
            if not texts:
                continue
            h = token_hashes(texts)
            distinct, inverse = np.unique(h, return_inverse=True)
            bi = np.concatenate([[0], bound.level(mix(h[:-1], h[1:]))])
            yield scorer.rows([b.column(c) for c in ("row", "doc_id", "held_out")], texts, h, bound.level(distinct)[inverse], bi)

    return src.mapInArrow(run, Scorer.SCHEMA)


def chunk_grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, distinct hashes of a chunk's n-grams as the filter tells them apart, the place of each unigram and bigram there)."""
    h = token_hashes(texts)
    distinct, inverse = np.unique(np.concatenate([h, mix(h[:-1], h[1:])]) & KEPT, return_inverse=True)
    return h, distinct, inverse


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, its rows) of batches in the order of ``chunk``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        values = b.column("chunk").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and held[0].column("chunk")[0].as_py() != int(values[i]):
                yield held[0].column("chunk")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield held[0].column("chunk")[0].as_py(), pa.Table.from_batches(held)


def by_segments(src: DataFrame, bitmaps: DataFrame, segments: int, blocks: int, scorer: Scorer) -> DataFrame:
    """The same rows from a filter that stays in its segments.

    Two shuffles of streams sorted by key: n-grams behind the segment that owns them, then texts behind their
    chunk's levels. A task holds a segment and a row of n-grams, then a chunk.
    """
    per = blocks // segments
    src = src.withColumn("chunk", F.floor(F.col("row") / CHUNK_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        for chunk, rows in chunks(batches):
            _, distinct, _ = chunk_grams([words(x) for x in rows.column("text").to_pylist()])
            cuts = np.searchsorted(block_of(distinct, blocks), np.arange(segments + 1, dtype=np.uint64) * np.uint64(per))
            which = np.flatnonzero(np.diff(cuts)).tolist()
            packed = [pack_hashes(distinct[cuts[s] : cuts[s + 1]]) for s in which]
            sizes = [int(cuts[s + 1] - cuts[s]) for s in which]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([chunk] * len(which), pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], ["segment", "chunk", "payload", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for b in batches:
            out: list[tuple[int, int, bytes]] = []
            for segment, chunk, payload, n in zip(*(b.column(c).to_pylist() for c in ("segment", "chunk", "payload", "n"))):
                if chunk < 0:
                    part = Filter(np.frombuffer(payload, np.uint8), segment * per, blocks)
                else:
                    out.append((chunk, segment, part.level(unpack_hashes(payload, n)).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["chunk", "segment", "levels"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(word_hashes)
        for _, rows in chunks(batches):
            rows = rows.combine_chunks()
            is_text = pc.is_null(rows.column("levels"))
            level = np.frombuffer(b"".join(rows.column("levels").drop_null().to_pylist()), np.uint8).astype(np.int64)
            docs = rows.filter(is_text).combine_chunks().to_batches()[0]
            texts = [words(x) for x in docs.column("text").to_pylist()]
            h, _, inverse = chunk_grams(texts)
            uni, bi = level[inverse[: len(h)]], np.concatenate([[0], level[inverse[len(h) :]]])
            yield scorer.rows([docs.column(c) for c in ("row", "doc_id", "held_out")], texts, h, uni, bi)

    asked = src.select("chunk", "text").mapInArrow(ask, "segment long, chunk long, payload binary, n int")
    owners = bitmaps.select("segment", F.lit(-1).cast("long").alias("chunk"), F.col("bits").alias("payload"), F.lit(0).alias("n"))
    dealt = owners.unionByName(asked).repartition("segment").sortWithinPartitions("segment", "chunk")
    answers = dealt.mapInArrow(answer, "chunk long, segment long, levels binary")
    none = lambda t: F.lit(None).cast(t)
    heads = answers.select("chunk", F.lit(-1).cast("long").alias("row"), "segment", "levels", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    bodies = src.select("chunk", "row", none("long").alias("segment"), none("binary").alias("levels"), "doc_id", "held_out", "text")
    return heads.unionByName(bodies).repartition("chunk").sortWithinPartitions("chunk", "row", "segment").mapInArrow(score, Scorer.SCHEMA)


def scores(docs: DataFrame, parts: int = 10, mu: float = MU, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The training rows are those whose id's crc32 is no multiple of ``parts``. Null and empty texts
    have one token, their end. Rows that repeat an id are scored apart, each as a row of its own; a null id
    is folded like an empty one. Without training rows every count is zero. Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    fold = (id_fold(F.col("doc_id"), parts) == 0).alias("held_out")
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), fold, text_or_empty(F.col("text")).alias("text"))
    train = src.where("not held_out").select("text")
    counts = materialise(word_counts(train), "words")
    n_train, v_train = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())

    segments = max(1, -(-n_train // SEGMENT_GRAMS))
    blocks = segments * max(1, -(-n_train * BITS_PER_TOKEN // (segments * BLOCK_BITS)))
    segment_bytes = blocks // segments * BLOCK_BITS // 8
    bitmaps = materialise(segment_bitmaps(train, segments, blocks), "filter")

    top = counts.where(F.octet_length("word") <= COMMON_BYTES).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).toArrow()
    keys = np.array([xxhash.xxh64_intdigest(w, 7) for w in top["word"].to_pylist()], np.uint64)
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order]))
    scorer, shared = Scorer(common, n_train, v_train, mu), [common]
    if segments * segment_bytes <= max_filter_bytes:
        bits = np.zeros(segments * segment_bytes, np.uint8)
        for segment, raw in bitmaps.toLocalIterator():
            bits[segment * segment_bytes : (segment + 1) * segment_bytes] = np.frombuffer(raw, np.uint8)
        shared.append(spark.sparkContext.broadcast(Filter(bits, 0, blocks)))
        del bits
        rows = materialise(by_broadcast(src, shared[1], scorer), "scored")
    else:
        rows = materialise(by_segments(src, bitmaps, segments, blocks, scorer), "scored")
    for x in shared:
        x.destroy()
    release(bitmaps)

    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    seen = rare.join(counts, "word", "left").groupBy("row")
    sums = seen.agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    norm = math.log10(n_train + 0.1 * (v_train + 1))
    return rows.drop("rare", "rare_n").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_log") + F.coalesce("rare_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )

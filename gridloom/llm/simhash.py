"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``k`` bits differ in at most ``k`` of their 8 bytes, so they share
``8 - k`` byte positions at least. The index lists fingerprints under small sets of positions with
their values: sets chosen so that any ``8 - k`` positions contain one of them whole. Pairs that meet
in a list have their shared positions tallied, those that reach the guaranteed minimum are kept, and
their Hamming distance is verified. Equal fingerprints are one entry, so copies never make pairs.

A list of any length is worked in blocks of bounded size; a block pair reports only the links that
connect what is not yet connected within it, so its output grows with its fingerprints, not pairs.

Near-duplicates by Jaccard similarity (the pipeline's stage) use the same index over other positions: sign
bits of a fingerprint differ too much at a similarity of 0.8 to be told from 0.7, so a text's positions
hold the minima of its shingles under ``POSITIONS`` mixtures instead. The index lists texts under small
sets of positions with their values, the bytes that a pair shares over all positions are tallied, pairs
that reach ``MINIMUM`` are retained, and each of these is verified exactly on the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, connected, forget, fresh, materialise, release, text_or_empty, words

BYTES = 8
SEED = 42
#: Fingerprints of a list that are compared at once.
BLOCK = 1024
#: Lists up to this length are compared all at once, many lists in one step.
SHORT = 8


def shingle_hashes(ws: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``size``-word shingle, repeats included; fewer words: of the whole sequence."""
    if not ws:
        return np.empty(0, np.uint64)
    text = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    n = max(1, len(ws) - size + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(size, len(ws)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray, width: int = 1) -> list[int]:
    """``width`` signed 64-bit words: a bit is 1 if set in over half the hashes; none: zero.

    The first word counts the hashes themselves, each further one a fixed mixture of them.
    """
    out = []
    for word in range(width):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 8192):
            part = hashes[i : i + 8192]
            if word:
                part = (part ^ (part >> np.uint64(31))) * np.uint64(2 * (0x9E3779B97F4A7C15 * word >> 1) + 1 & 0xFFFFFFFFFFFFFFFF)
                part ^= part >> np.uint64(29)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0)
    return out


def names(width: int) -> list[str]:
    return [f"fp{i}" for i in range(width)]


def fingerprints(docs: DataFrame, shingle: int = 3, width: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp0, ...) per row, from whole texts; null text is empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            fps = [fingerprint(shingle_hashes(words(x), shingle), width) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([x[i] for x in fps], pa.int64()) for i in range(width)]], ["doc_id", *names(width)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names(width)))


def covering(key_bytes: int, groups: int) -> list[tuple[int, ...]]:
    """Position sets of ``key_bytes`` each, all within one of ``groups`` runs of positions.

    Among any ``groups * (key_bytes - 1) + 1`` positions one run has ``key_bytes`` (pigeonhole).
    """
    run = BYTES // groups
    return [c for g in range(groups) for c in combinations(range(g * run, (g + 1) * run), key_bytes)]


def index_keys(max_bits: int) -> list[tuple[int, ...]]:
    """The most selective covering whose guarantee fits ``BYTES - max_bits`` shared positions."""
    shared = BYTES - max_bits
    if shared < 1:
        raise ValueError("no byte position is sure to be shared")
    size, groups = max(((k, g) for g in (1, 2, 4, 8) for k in range(1, BYTES // g + 1) if g * (k - 1) + 1 <= shared and len(covering(k, g)) <= 16), key=lambda x: x[0])
    return covering(size, groups)


def _links(fps: np.ndarray, ids: np.ndarray, split: int, shared: int, max_bits: int) -> tuple[list[int], list[int]]:
    """Links that join the components within rows [0, split) and [split, n), a forest over both.

    split 0: all pairs of one block. Else the halves' own links are reported by their own block
    pair and only used here to leave out links between what hangs together already.
    """
    n = len(fps)
    raw = np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1)
    group = np.arange(n)
    a_out: list[int] = []
    b_out: list[int] = []

    def compare(i: int, lo: int, hi: int, report: bool) -> None:
        other = lo + np.flatnonzero(group[lo:hi] != group[i])
        other = other[(raw[other] == raw[i]).sum(axis=1) >= shared]
        other = other[np.bitwise_count(fps[other] ^ fps[i]).sum(axis=1) <= max_bits]
        for j in other.tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                if report:
                    a_out.append(int(ids[i]))
                    b_out.append(int(ids[j]))

    for i in range(n):
        compare(i, i + 1, split if i < split else n, report=not split)
    for i in range(split):
        compare(i, split, n, report=True)
    return a_out, b_out


def _short_lists(fps: np.ndarray, ids: np.ndarray, which: np.ndarray, shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within lists of at most SHORT entries; ``which`` numbers each entry's list, in order."""
    a_out, b_out = [], []
    for step in range(1, SHORT):
        at = np.flatnonzero(which[step:] == which[:-step])
        if not len(at):
            break
        x, y = fps[at], fps[at + step]
        tally = (x.view(np.uint8).reshape(len(at), -1) == y.view(np.uint8).reshape(len(at), -1)).sum(axis=1)
        ok = (tally >= shared) & (np.bitwise_count(x ^ y).sum(axis=1) <= max_bits)
        a_out.append(ids[at[ok]])
        b_out.append(ids[at[ok] + step])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def links(classes: DataFrame, index_bits: int = 3, shared: int = 5, max_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(id long, fp0, ...), one row per distinct fingerprint -> (a, b) links spanning every component.

    Each word is indexed so that ``index_bits`` differing bits cannot hide a pair; a pair that shares
    ``shared`` byte positions over all words and differs in ``max_bits`` bits at most is a link. Lists of
    one fingerprint are dropped by a count; a list of more than ``block`` is dealt by hash into
    blocks, and each pair of its blocks is a row of the next stage.
    """
    cols = [c for c in classes.columns if c != "id"]
    masks = [sum(0xFF << (8 * p) for p in c) for c in index_keys(index_bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    places = [(c, m) for c in cols for m in signed]
    key = F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("list"), F.col(c).bitwiseAND(F.lit(m)).alias("value")) for i, (c, m) in enumerate(places)]))
    posted = classes.select("id", *cols, key.alias("key")).select("id", *cols, "key.list", "key.value")
    sizes = materialise(posted.groupBy("list", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    met = posted.join(sizes, ["list", "value"])
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = met.withColumn("own", F.pmod(F.xxhash64(*cols), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = dealt.groupBy("list", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    pairs = rows.agg(F.collect_list(F.struct((F.col("own") == F.greatest("own", "other")).alias("late"), "id", *cols)).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("entries")
            at = lists.offsets.to_numpy().astype(np.int64)
            late, ids, *words_ = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            at = at - at[0]
            fps = np.stack(words_, axis=1).view(np.uint64)
            mixed = np.array(b.column("mixed").to_pylist(), bool)
            size = np.diff(at)
            short = ~mixed & (size <= SHORT)
            which = np.repeat(np.arange(len(size)), size)
            pick = short[which]
            a, c = _short_lists(fps[pick], ids[pick], which[pick], shared, max_bits)
            a_all, b_all = a.tolist(), c.tolist()
            for k in np.flatnonzero(~short).tolist():
                lo, hi = int(at[k]), int(at[k + 1])
                order = lo + np.lexsort((fps[lo:hi, 0], late[lo:hi]))
                split = int(hi - lo - late[lo:hi].sum()) if mixed[k] else 0
                if mixed[k] and split in (0, hi - lo):
                    continue
                x, y = _links(fps[order], ids[order], split, shared, max_bits)
                a_all += x
                b_all += y
            yield pa.RecordBatch.from_arrays([pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64())], ["a", "b"])

    return pairs.select((F.col("x") != F.col("y")).alias("mixed"), "entries").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, width: int = 1, index_bits: int = 3, shared: int = 5, max_bits: int = 3, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp0, ..., component_id per row: documents whose fingerprints link, directly or by others.

    ``component_id`` is the smallest doc_id of the group. Rows without words have fingerprint zero
    and link like any other; rows that repeat a doc_id each get the group of their own text. A row with
    a null id gets its group's component but carries no link of its own; alone it gets null.
    """
    cols = names(width)
    rows = materialise(fingerprints(docs, shingle, width, id_col), "fingerprints")
    classes = materialise(rows.groupBy(*cols).agg(F.min("doc_id").alias("id")), "classes")
    roots = connected(links(classes.where("id is not null"), index_bits, shared, max_bits))
    by_fp = materialise(classes.join(roots, classes["id"] == roots["node"], "left").select(*cols, F.coalesce("root", "id").alias("component_id")), "components")
    return rows.join(by_fp, cols, "left").select("doc_id", *cols, "component_id")


#: Near-duplicate documents: sets of five-word shingles whose Jaccard similarity is 4/5 or more.
NEAR_SHINGLE = 5
NEAR = (4, 5)
#: Sets of positions that propose pairs: (1 - 0.8 ** 4) ** 32 < 5e-8 of the pairs at 0.8 meet in none.
BANDS, BAND_ROWS = 32, 4
POSITIONS = BANDS * BAND_ROWS
#: Bytes that a pair shares at least: 3e-9 of the pairs at 0.8 have fewer of 128; half are shared at 0.5.
MINIMUM = 74
#: Most rounds that compare each open list with one of its members before blocks of it are compared.
LEADER_ROUNDS = 6
#: Blocks are compared at once while their lists have at most this many pairs apart for each listed entry.
PAIRS_PER_ENTRY = 4
#: Entries and bytes of shingles of a block.
NEAR_BLOCK, NEAR_BYTES = 1024, 8 << 20
#: Bits of a set's sketch that bounds what it shares with another.
SKETCH = 4096

_SPREAD = np.random.default_rng(SEED).integers(0, 2**63, POSITIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles."""
    return np.unique(shingle_hashes(words(text), NEAR_SHINGLE))


def positions(shingles: np.ndarray) -> np.ndarray:
    """The least of each mixture of the hashes; all ones without any."""
    least = np.full(POSITIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[i : i + 2048, None] * _SPREAD).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each set of BAND_ROWS positions, made of its number and its values."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def position_bytes(least: np.ndarray) -> bytes:
    """A byte of each position: one of its middle bits' bytes, since the least have zeros in front."""
    return ((least >> np.uint64(16)) & np.uint64(255)).astype(np.uint8).tobytes()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact: the Jaccard similarity of two sets of distinct hashes is NEAR or more."""
    part, whole = NEAR
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return whole * both >= part * (len(x) + len(y) - both)


def banded(docs: DataFrame) -> DataFrame:
    """(id, whole, size, places, bands) of rows (id, text): the shingle set's digest and size, its positions' bytes, its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            sets = [shingle_set(x) for x in b.column("text").to_pylist()]
            least = [positions(x) for x in sets]
            cols = [pa.array([xxhash.xxh128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([position_bytes(x) for x in least], pa.binary()), pa.array([bands(x) for x in least], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "whole", "size", "places", "bands"])

    return docs.mapInArrow(run, "id long, whole binary, size long, places binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles binary) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            sets = pa.array([shingle_set(x).tobytes() for x in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), sets], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def retained(pairs: DataFrame, places: DataFrame, minimum: int) -> DataFrame:
    """The pairs (a, b) that share ``minimum`` positions' bytes at least; ``places``: id, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= minimum))

    left = pairs.join(places.select(F.col("id").alias("a"), F.col("places").alias("x")), "a")
    both = left.join(places.select(F.col("id").alias("b"), F.col("places").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar; only the sets of paired texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            ok = [similar(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64)) for u, v in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(z)).join(pairs.select(c), c, "left_semi") for c, z in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def distinct_lists(met: DataFrame) -> DataFrame:
    """The entries (value, id, ...) of one of the lists that have the very same members, told by count and two sums of hashes."""
    sums = [F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x")]
    each = met.groupBy("value").agg(F.count(F.lit(1)).alias("n"), *sums)
    once = materialise(each.groupBy("n", "s", "x").agg(F.min("value").alias("value")).select("value"), "once")
    out = materialise(met.join(once, "value", "left_semi"), "met")
    release(once)
    return out


def open_lists(named: DataFrame, turn: int) -> DataFrame:
    """(value, lead, lead_root, apart) of the lists of (value, id, root) that span components: another member each turn, and the pairs apart."""
    part = named.groupBy("value", "root").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id")).alias("first"))
    apart = ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart")
    lead = F.min(F.struct("first.h", "first.id", "root")).alias("lead")
    spans = part.groupBy("value").agg(F.count(F.lit(1)).alias("roots"), apart, lead).where("roots > 1")
    return spans.select("value", F.col("lead.id").alias("lead"), F.col("lead.root").alias("lead_root"), "apart")


def near_links(posted: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(value, id) index entries, (id, size, places), (id, text) -> (node, root): components of all similar pairs that share a list.

    A pair needs no comparison once other links connect it. So lists are first compared with one
    member each, another in each round while that halves the pairs apart; what still spans components is
    then compared in blocks. Lists of the very same members are one; a list within one component is done
    with, and no later round reads it.
    """
    lists = materialise(posted.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("leader")).where("n > 1"), "lists")
    listed_all = materialise(posted.join(lists, "value").select("value", "id", "leader"), "met")
    met = distinct_lists(listed_all)
    listed = materialise(met.select("id").distinct(), "listed")
    sets = materialise(shingle_sets(texts.join(listed, "id", "left_semi")), "sets")
    held = materialise(places.join(listed, "id", "left_semi"), "places")
    release(lists, listed_all, listed)
    counts = met.groupBy("value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    entries, before = counts.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("n"), F.col("n") * (F.col("n") - 1) / 2)]).first()
    tested = [materialise(met.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")]
    found = _tested_links(tested[0], held, sets)
    roots = connected(found)
    for turn in range(1, LEADER_ROUNDS + 1):
        named = materialise(met.select("value", "id").join(roots, F.col("id") == F.col("node"), "left").select("value", "id", F.coalesce("root", "id").alias("root")), "named")
        spans = materialise(open_lists(named, turn), "open")
        left = spans.agg(F.sum("apart")).first()[0] or 0
        last = turn == LEADER_ROUNDS or left <= PAIRS_PER_ENTRY * entries or 2 * left > before
        before = left
        among = materialise(named.join(spans, "value").select("value", "id", "root", "lead", "lead_root"), "met")
        release(met, named, spans)
        met = among
        if not left:
            new = None
        elif last:
            new = spanning_links(met.select("value", "id", "root"), held, sets)
        else:
            pairs = met.where("root <> lead_root").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
            for earlier in tested:
                pairs = pairs.join(earlier, ["a", "b"], "left_anti")
            tested.append(materialise(pairs, "pairs"))
            new = _tested_links(tested[-1], held, sets)
        if new is not None and not new.isEmpty():
            earlier = (found, new, roots)
            found = materialise(found.unionByName(new), "similar")
            roots = connected(found)
            release(*earlier)
        elif new is not None:
            release(new)
        if last or not left:
            break
    release(met, sets, held, found, *tested)
    return roots


def _tested_links(pairs: DataFrame, held: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of some pairs, written; what lies between is deleted."""
    kept = materialise(retained(pairs, held, MINIMUM), "retained")
    out = materialise(verified(kept, sets), "similar")
    release(kept)
    return out


def _may_be_similar(i: int, other: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of ``other`` can be similar to i: a bit that only one side has is a shingle that the other lacks."""
    part, whole = NEAR
    lacks = np.bitwise_count(bits[i] & ~bits[other]).sum(axis=1, dtype=np.int64)
    lacked = np.bitwise_count(~bits[i] & bits[other]).sum(axis=1, dtype=np.int64)
    most = np.minimum(size[i] - lacks, size[other] - lacked)
    return other[(part + whole) * most >= part * (size[i] + size[other])]


def _spanning(ids: np.ndarray, roots: np.ndarray, places: np.ndarray, sets: list[np.ndarray], split: int) -> tuple[list[int], list[int]]:
    """Similar pairs that connect what ``roots`` and the pairs before leave apart: fewer than entries.

    split 0: all pairs of one block; else those between rows [0, split) and [split, n).
    """
    size = np.array([len(x) for x in sets], np.int64)
    bits = np.zeros((len(sets), SKETCH), bool)
    for k, x in enumerate(sets):
        bits[k, x & np.uint64(SKETCH - 1)] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    group = np.unique(roots, return_inverse=True)[1]
    a_out: list[int] = []
    b_out: list[int] = []
    for i in range(split or len(sets)):
        lo = split or i + 1
        other = lo + np.flatnonzero(group[lo:] != group[i])
        other = other[(places[other] == places[i]).sum(axis=1) >= MINIMUM]
        for j in _may_be_similar(i, other, size, bits).tolist():
            if group[j] != group[i] and similar(sets[i], sets[j]):
                group[group == group[j]] = group[i]
                a_out.append(int(ids[i]))
                b_out.append(int(ids[j]))
    return a_out, b_out


def spanning_links(among: DataFrame, held: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), written: similar pairs that connect the components within lists (value, id, root).

    A list is dealt by hash into blocks bounded in entries and bytes; each pair of blocks is a row
    that has its texts' positions and shingles, so that positions are tallied, lengths and sketches
    bounded and sets verified within a task. No pair leaves it but a link that connects.
    """
    sized = among.join(held.select("id", "size"), "id")
    each = sized.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = F.ceil(F.greatest(F.col("n") / NEAR_BLOCK, 8 * F.col("size") / NEAR_BYTES, F.lit(1.0))).cast("int")
    dealing = materialise(each.select("value", parts.alias("parts")), "dealing")
    entry = materialise(among.join(dealing, "value").join(held.select("id", "places"), "id").join(sets, "id"), "entries")
    dealt = entry.withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.groupBy("value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    late = (F.col("own") == F.greatest("own", "other")).alias("late")
    blocks = rows.agg(F.collect_list(F.struct(late, "id", "root", "places", "shingles")).alias("entries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            a_all: list[int] = []
            b_all: list[int] = []
            for mixed, entries in zip(b.column("mixed").to_pylist(), b.column("entries")):
                late, ids, roots, places, shingles = entries.values.flatten()
                late = late.to_numpy(zero_copy_only=False)
                order = np.argsort(late, kind="stable")
                split = int(len(late) - late.sum()) if mixed else 0
                if mixed and split in (0, len(late)):
                    continue
                byte = np.frombuffer(b"".join(places.to_pylist()), np.uint8).reshape(-1, POSITIONS)
                of = [np.frombuffer(shingles[k].as_py(), np.uint64) for k in order.tolist()]
                x, y = _spanning(ids.to_numpy()[order], roots.to_numpy()[order], byte[order], of, split)
                a_all += x
                b_all += y
            yield pa.RecordBatch.from_arrays([pa.array(a_all, pa.int64()), pa.array(b_all, pa.int64())], ["a", "b"])

    links = blocks.select((F.col("x") != F.col("y")).alias("mixed"), "entries").mapInArrow(run, "a long, b long")
    out = materialise(links, "similar")
    release(dealing, entry)
    return out


def near_groups(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, component_id) per row: texts whose shingle sets are similar (NEAR), directly or by others.

    Equal sets are one entry of the index; texts without words have the empty set and are equal.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col("text")).alias("text"))
    rows = materialise(banded(texts), "positions")
    classes = materialise(rows.groupBy("whole").agg(F.min("id").alias("id")), "classes")
    posted = rows.join(classes.select("id"), "id").select("id", F.explode("bands").alias("value"))
    roots = near_links(posted, rows.select("id", "size", "places"), texts)
    by_set = materialise(classes.join(roots, classes["id"] == roots["node"], "left").select("whole", F.coalesce("root", "id").alias("component_id")), "components")
    release(classes, roots)
    return rows.select("id", "whole").join(by_set, "whole").select("id", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates (NEAR) with all its columns: the smallest doc_id's.

    Null, empty and blank texts are one group. Groups are of rows, so repeated and null ids do no harm;
    equal ids are told apart by scan order, a null id comes last. An empty table stays empty. Columns may
    have any names.
    """
    row = fresh("near_row", docs.columns)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    ids = numbered.select(F.col(row).alias("near_row"), "doc_id")
    found = near_groups(numbered.select(F.col(row).alias("near_row"), "text"), "near_row").withColumnRenamed("id", "near_row")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "near_row")
    named = found.join(ids, "near_row")
    first = materialise(named.groupBy("component_id").agg(F.min(rank)["near_row"].alias("near_row")).select("near_row"), "kept")
    # The dropped rows are the smaller side by far: texts need no shuffle while these are few.
    dropped = materialise(found.select("near_row").join(first, "near_row", "left_anti").select(F.col("near_row").alias(row)), "dropped")
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def component_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row, as ``groups`` defines them; other columns are not read."""
    out = groups(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")

"""Periodic runs of words, found on a grammar of each document.

The word ids of a document are compressed by Re-Pair: in every round each pair of neighbours that occurs twice
or more, and more often than the pairs that overlap it, becomes a nonterminal everywhere. Rounds run over all
documents of a chunk at once; ids are a document's own, so no pair crosses two documents. A run lies across the
middle of the smallest nonterminal that holds it, or across a boundary of the start sequence. So the runs that
cross the middle of each nonterminal are computed once, at its first derivation, translated to all others, and
merged with those across the start sequence's boundaries: an interval within another one of its period goes.

What crosses a boundary with period q and at least 4 q words has 2 q of them on one side. Periods are tried by
powers of two: words of length g name the places that may repeat at a distance from g to 2 g (names of length 2 g
are made of two names of length g, of places that repeat only), and the same names extend a repeat to both sides.
Texts are rows of their own throughout; nothing is shuffled or gathered.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches

#: A run has so many words, and so many times its period, at least.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are compressed at a time; a longer document is a chunk of its own.
CHUNK_WORDS = 250_000

Runs = list[tuple[int, int, int]]
Prepare = Callable[[object, list[bytes]], list[bytes]]


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, other ones in every document, and where each document starts (and the last one ends)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    ids, used = np.empty(starts[-1], np.int64), 0
    for i, d in enumerate(docs):
        names = dict(zip(dict.fromkeys(d), range(len(d))))
        ids[starts[i] : starts[i + 1]] = np.fromiter(map(names.__getitem__, d), np.int64, len(d)) + used
        used += len(names)
    return ids, starts


def _classes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code the number of its class and how often it occurs; the stable order of the codes."""
    order = np.argsort(codes, kind="stable")
    new = np.ones(len(codes), bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group)[group] if len(codes) else group, order


class Tier:
    """Names of the stretches of ``g`` words: equal numbers for equal stretches, a negative one of its own for one that is unique."""

    def __init__(self, g: int, names: np.ndarray, places: np.ndarray) -> None:
        self.g, self.names = g, names
        n = len(names)
        self.keys = np.sort(names[places] * n + places) if g >= LEAST_PERIODS else None

    def between(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``x``, place): places from ``low`` to ``high`` that bear the name of ``x``."""
        known = np.flatnonzero((self.names[x] >= 0) & (low <= high))
        base = self.names[x[known]] * len(self.names)
        first = np.searchsorted(self.keys, base + low[known], "left")
        count = np.searchsorted(self.keys, base + high[known], "right") - first
        which = np.repeat(np.arange(len(known)), count)
        at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]
        return known[which], self.keys[at] - base[which]


def tiers(ids: np.ndarray) -> list[Tier]:
    """Names of 1, 2, 4, ... words, as long as a stretch repeats in its document."""
    n = len(ids)
    names = np.where(np.bincount(ids)[ids] > 1, ids, -1 - np.arange(n)) if n else ids
    out = [Tier(1, names, np.flatnonzero(names >= 0))]
    while True:
        last, g = out[-1].names, out[-1].g
        at = np.flatnonzero((last[: max(0, n - g)] >= 0) & (last[g:] >= 0))
        group, often, _ = _classes(last[at] * n + last[at + g])
        at, group = at[often > 1], group[often > 1]
        if not len(at):
            return out
        names = -1 - np.arange(n)
        names[at] = group
        out.append(Tier(2 * g, names, at))


class Grammar:
    """Re-Pair of all documents: ``bounds`` between symbols of the start sequences; nonterminals by number with the
    length of either side, and every place where one is derived."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray) -> None:
        seq, at = ids.copy(), np.arange(len(ids))
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.words = first_free = int(ids.max(initial=-1)) + 1
        lengths = [np.ones(first_free, np.int64)]
        left, symbols, places, bounds = [], [], [], []
        length = lengths[0]
        while len(seq):
            same = np.zeros(len(seq), bool)
            same[:-1] = seq[:-1] == seq[1:]
            # Of equal symbols in a row, the first and second are a pair, the third and fourth, and so on.
            since = np.maximum.accumulate(np.where(np.r_[True, ~same[:-1]], np.arange(len(seq)), 0))
            often = np.bincount(seq, minlength=first_free)[seq] > 1
            open_ = np.zeros(len(seq), bool)
            open_[:-1] = often[:-1] & often[1:] & ~(same[:-1] & ((np.arange(len(seq) - 1) - since[:-1]) % 2 == 1))
            where = np.flatnonzero(open_)
            group, count, _ = _classes(seq[where] * first_free + seq[where + 1])
            rank = np.zeros(len(seq) + 1, np.int64)  # the last one stands before the first as well
            rank[where] = np.where(count > 1, count * (len(where) + 1) + group + 1, 0)
            here = rank[where]
            best = (here > 0) & (here > rank[where - 1]) & (here > rank[where + 1])
            taken, group = where[best], group[best]
            twice = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
            taken, group = taken[twice], group[twice]
            busy = np.zeros(len(starts), bool)
            busy[doc[taken]] = True
            done = ~busy[doc]
            bounds.append(at[done])
            if not len(taken):
                break
            _, one, number = np.unique(group, return_index=True, return_inverse=True)
            left.append(length[seq[taken[one]]])
            lengths.append(length[seq[taken[one]]] + length[seq[taken[one] + 1]])
            symbols.append(number + first_free)
            places.append(at[taken])
            seq[taken] = number + first_free
            keep = ~done
            keep[taken + 1] = False
            seq, at, doc = seq[keep], at[keep], doc[keep]
            first_free += len(one)
            length = np.concatenate([length, lengths[-1]])
        self.length = length
        self.left = np.concatenate([np.zeros(self.words, np.int64), *left])
        self.symbols = np.concatenate([np.zeros(0, np.int64), *symbols])
        self.places = np.concatenate([np.zeros(0, np.int64), *places])
        self.bounds = np.sort(np.concatenate([np.zeros(0, np.int64), *bounds]))


def _reach(levels: list[Tier], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many words from x on equal those from y on (``back``: words up to x and y, leftwards)."""
    n, total = len(levels[0].names), np.zeros(len(x), np.int64)
    for t in reversed(levels):
        a, b = (x - total - t.g + 1, y - total - t.g + 1) if back else (x + total, y + total)
        inside = (a >= 0) & (b < n)
        total += t.g * (inside & (t.names[np.where(inside, a, 0)] == t.names[np.where(inside, b, 0)]) & (a != b))
    return total


def _crossing(levels: list[Tier], b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index into b, start, end, period) of the runs of low..high that have words on both sides of b."""
    n, found = len(levels[0].names), []
    two = levels[1].names if len(levels) > 1 else -1 - np.arange(n)
    for back in (0, 2):  # the two words after the boundary, or those before it
        ok = np.flatnonzero((b - back >= low) & (b - back < n))
        ok = ok[two[b[ok] - back] >= 0]
        for q in range(1, LEAST_PERIODS):
            x = b[ok] - (back and back + q)
            near = np.flatnonzero((x >= low[ok]) & (x + q + 2 <= high[ok]))
            near = near[two[x[near]] == two[x[near] + q]]
            found.append((ok[near], x[near], np.full(len(near), q)))
    for t in levels[2:]:
        most = np.minimum(2 * t.g - 1, (high - low) // LEAST_PERIODS)
        ok = np.flatnonzero(b + t.g < high)
        which, y = t.between(b[ok], b[ok] + t.g, np.minimum(b[ok] + most[ok], high[ok] - 1))
        found.append((ok[which], b[ok[which]], y - b[ok[which]]))
        ok = np.flatnonzero(b - t.g >= low)
        x = b[ok] - t.g
        which, y = t.between(x, np.maximum(x - most[ok], low[ok]), x - t.g)
        found.append((ok[which], y, x[which] - y))
    at, x, q = (np.concatenate(p) for p in zip(*found))
    end = np.minimum(x + q + _reach(levels, x, x + q, False), high[at])
    start = np.maximum(x - _reach(levels, x - 1, x + q - 1, True), low[at])
    good = (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (start < b[at]) & (b[at] < end)
    return at[good], start[good], end[good], q[good]


def _smallest(*columns: np.ndarray) -> list[np.ndarray]:
    """Rows of the last column's smallest value for equal other ones."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:-1]])
    return [c[new] for c in rows]


def runs_of(docs: list[list[bytes]]) -> list[Runs]:
    """Of each document its runs (start, length, period), by start and period."""
    ids, starts = _numbered(docs)
    out: list[Runs] = [[] for _ in docs]
    if not len(ids):
        return out
    levels, grammar = tiers(ids), Grammar(ids, starts)
    if len(levels) == 1:  # no two words stand together twice
        return out
    doc = np.searchsorted(starts, grammar.bounds, "right") - 1
    inner = grammar.bounds != starts[doc]
    b, doc = grammar.bounds[inner], doc[inner]
    _, start, end, period = _crossing(levels, b, starts[doc], starts[doc + 1])

    symbol, first = np.unique(grammar.symbols, return_index=True)
    long = grammar.length[symbol] >= LEAST_WORDS
    symbol, origin = symbol[long], grammar.places[first[long]]
    at, s, e, q = _smallest(*_crossing(levels, origin + grammar.left[symbol], origin, origin + grammar.length[symbol]))
    if len(at):
        order = np.argsort(grammar.symbols, kind="stable")
        low, high = (np.searchsorted(grammar.symbols[order], symbol[at], side) for side in ("left", "right"))
        of = np.repeat(np.arange(len(at)), high - low)
        there = grammar.places[order[np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[of]]]
        move = there - origin[at[of]]
        start, end, period = np.r_[start, s[of] + move], np.r_[end, e[of] + move], np.r_[period, q[of]]

    start, end, period = _smallest(start, end, period)
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    marks = end + period * (len(ids) + 1)
    whole = np.ones(len(marks), bool)
    whole[1:] = np.maximum.accumulate(marks)[:-1] < marks[1:]
    start, end, period = start[whole], end[whole], period[whole]
    order = np.lexsort((period, start))
    doc = np.searchsorted(starts, start[order], "right") - 1
    for d, s, e, q in zip(doc.tolist(), (start[order] - starts[doc]).tolist(), (end[order] - starts[doc]).tolist(), period[order].tolist()):
        out[d].append((s, e - s, q))
    return out


def collapsed(words: list[bytes], runs: Runs) -> list[bytes]:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's periodic tails: in a tenth of the documents the words from some place on repeat."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _chunks(ids: list, texts: pa.Array, prepare: Prepare | None) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    rows, docs, total = [], [], 0
    for i, text in enumerate(texts.cast(pa.binary())):
        words = (text.as_py() or b"").split()  # bytes know the six blanks of ASCII only
        words = prepare(ids[i], words) if prepare else words
        if rows and total + len(words) > CHUNK_WORDS:
            yield rows, docs
            rows, docs, total = [], [], 0
        rows, docs, total = [*rows, i], [*docs, words], total + len(words)
    if rows:
        yield rows, docs


def _best(runs: Runs) -> tuple:
    """start, length, period and thousandths of the run of the greatest length by period; the first of equal ones."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (*best, 1000 * best[1] // best[2]) if best else (None,) * 4


def _mapped(docs: DataFrame, columns: list[str], prepare: Prepare | None, schema: str, row: Callable[[list[bytes], Runs], list[tuple]]) -> DataFrame:
    """Rows ``row(words, runs)`` of every document, with its ``columns``."""
    bound_batches(docs.sparkSession)
    rest = [(f, t) for f, t in (part.rsplit(" ", 1) for part in schema.split(", "))]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns] + [f"`{f}` {t}" for f, t in rest])
    kinds = {"long": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("_id").to_pylist()
            for rows, words in _chunks(ids, b.column("_text"), prepare):
                made = [(i, r) for i, w, found in zip(rows, words, runs_of(words)) for r in row(w, found)]
                keep = pa.array([i for i, _ in made], pa.int64())
                values = [pa.array([r[c] for _, r in made], kinds[t]) for c, (_, t) in enumerate(rest)]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(keep) for c in columns], *values], [*columns, *[f for f, _ in rest]])

    return docs.select(*columns, F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).mapInArrow(run, out_schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): every run of every text, in words; null and empty texts have none."""
    return _mapped(docs, ["doc_id"], None, "start long, length long, period long", lambda _, found: found)


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, collapsed): every text with one period left of each run, words joined by one space; null as empty."""
    return _mapped(docs, ["doc_id"], None, "collapsed string", lambda words, found: [(b" ".join(collapsed(words, found)).decode("utf-8", "replace"),)])


def report(docs: DataFrame, prepare: Prepare | None = planted) -> DataFrame:
    """Runs of every document as counts, the run of the greatest exponent, and digests of all runs and of what is left.

    Null and empty texts have no words: no runs, four nulls, digests of nothing. A null id counts as empty text
    where it chooses a planted tail. Rows that repeat an id are rows of their own; other columns are not read;
    an empty table gives none. A text of any length is one chunk: about 150 bytes of memory a word.
    """

    def row(words: list[bytes], found: Runs) -> list[tuple]:
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = b" ".join(collapsed(words, found))
        return [(len(found), *_best(found), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())]

    return _mapped(docs, ["doc_id"], prepare, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row)

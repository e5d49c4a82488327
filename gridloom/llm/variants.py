"""Spelling variants: words one edit apart, by composition of automata.

The vocabulary is an acceptor A. A one-edit transducer T copies symbols and may replace, delete or insert one of
them; the pairs that A o T o A accepts are the near words. As A is deterministic and T copies before its edit, a state
of the composition before the edit is one state of A, that of the prefix read so far. The composition is enumerated
by such states: the words behind one prefix are a partition, with a minimised acceptor of their rests, whose accepted
pairs are those with the edit behind the prefix. A pair whose edit lies within a prefix of three letters has its last
three in common, since words have six letters or more; so the reversed vocabulary is composed likewise.

A prefix that gathers more than MOST_LETTERS is read on, letter by letter, down to DEEPEST; then, and for words
longer than LONGEST, the edits that neither direction reaches are enumerated as classes: words that are the same
without the letter at one place, one letter for each at most, so a class is as small as the alphabet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, materialise, release

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A near word so many times as frequent is the form of a word.
RATIO = 5
#: Letters of the prefixes that make partitions; what a partition may hold.
FIRST = 3
DEEPEST = 12
MOST_LETTERS = 400_000
#: Longer words are compared by classes only.
LONGEST = 256
#: The contract's typing errors: one run in so many of a document loses a letter.
DROPPED = 199
#: Modulus of the rolling hashes of long words, a Mersenne prime, and their base.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"variants").digest()[:15], "big")


def misspelt(doc_id: Column, run: Column) -> Column:
    """``run`` in which one letter is left out if its hash with the document's id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DROPPED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, spelt: Callable[[Column, Column], Column] = misspelt, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences in all texts, with A-Z lower-cased."""
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Runs that are too short give no word, misspelt or not.
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit("[A-Za-z\\u00C0-\\u00FF]{%d,}" % least_letters), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", low.alias("run"))
    words = runs.select(spelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def minimised(words: list[str]) -> tuple[dict[str, int], list[dict[str, int]], list[bool]]:
    """The minimal acceptor of sorted distinct words: arcs of its start, arcs of all states, and which of these accept."""
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[tuple[dict[str, int], list[bool], str]] = [({}, [False], "")]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            out, accepts, letter = path.pop()
            key = (accepts[0], *sorted(out.items()))
            state = known.get(key)
            if state is None:
                state = known[key] = len(arcs)
                arcs.append(out)
                final.append(accepts[0])
            path[-1][0][letter] = state

    last = ""
    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        close(common)
        for letter in w[common:]:
            path.append(({}, [False], letter))
        path[-1][1][0] = True
        last = w
    close(0)
    arcs.append(path[0][0])
    final.append(path[0][1][0])
    return path[0][0], arcs, final


def composed(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of sorted distinct words that the acceptor, the one-edit transducer and the acceptor again accept, each once."""
    _, arcs, final = minimised(words)
    shared: dict[tuple[int, int], list[str]] = {}

    def rests(p: int, q: int) -> list[str]:
        """What both states accept: the composition after its edit."""
        if p > q:
            p, q = q, p
        out = shared.get((p, q))
        if out is None:
            out = [""] if final[p] and final[q] else []
            a, b = arcs[p], arcs[q]
            for letter in a if len(a) <= len(b) else b:
                if letter in a and letter in b:
                    out += [letter + rest for rest in rests(a[letter], b[letter])]
            shared[p, q] = out
        return out

    work = [(len(arcs) - 1, "")]
    while work:
        state, prefix = work.pop()
        out = sorted(arcs[state].items())
        for i, (x, p) in enumerate(out):
            work.append((p, prefix + x))
            for y, q in out[i + 1 :]:
                for rest in rests(p, q):
                    yield prefix + x + rest, prefix + y + rest
            for rest in rests(p, state):
                if rest[:1] != x:  # of equal letters in a row the last one is deleted
                    yield prefix + rest, prefix + x + rest


def _partitions(words: DataFrame, backwards: bool, written: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of the partition of each word, depth null where even the deepest is crowded; and the partitions' entries."""
    left = words.select("id", (F.reverse("word") if backwards else F.col("word")).alias("word"))
    done = None
    for depth in range(FIRST, DEEPEST + 1):
        keyed = left.withColumn("state", F.substring("word", 1, depth))
        crowded = keyed.groupBy("state").agg(F.sum(F.char_length("word") + 1).alias("letters")).where(F.col("letters") > MOST_LETTERS).select("state")
        some = not crowded.isEmpty()
        here = (keyed.join(crowded, "state", "left_anti") if some else keyed).select("id", "word", "state", F.lit(depth).alias("depth"))
        done = here if done is None else done.unionByName(here)
        if not some:
            break
        left = materialise(keyed.join(crowded, "state", "left_semi").select("id", "word"), "crowded")
        written.append(left)
    else:
        done = done.unionByName(left.select("id", "word", F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("depth")))
    return done.select("id", "depth"), done.where("depth is not null").groupBy("depth", "state").agg(F.collect_list(F.struct("id", "word")).alias("entries"))


def _composition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for depth, entries in zip(b.column("depth").to_pylist(), b.column("entries").to_pylist()):
            if len(entries) < 2:
                continue
            ids = {e["word"][depth:]: e["id"] for e in entries}
            pairs = [(ids[u], ids[v]) for u, v in composed(sorted(ids))]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, rest, id) for each place of a word that neither direction reaches: the hash of the word without that letter,
    and of the whole word, to which a longer one may be equal without its letter there."""
    for b in batches:
        ats, rests, ids = [], [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ats, pa.int64()), pa.array(rests, pa.binary()), pa.array(ids, pa.int64())], ["at", "rest", "id"])
            ats.clear(), rests.clear(), ids.clear()
            return out

        for i, word, ahead, behind in zip(*(b.column(c).to_pylist() for c in ("id", "word", "ahead", "behind"))):
            n = len(word)
            ahead, behind = (n + 1 if x is None else x for x in (ahead, behind))
            heads, tails, powers = [0], [0] * (n + 1), [1]
            for c in word:
                heads.append((heads[-1] * BASE + ord(c) + 1) % PRIME)
                powers.append(powers[-1] * BASE % PRIME)
            for j in range(n - 1, -1, -1):
                tails[j] = (tails[j + 1] + (ord(word[j]) + 1) * powers[n - 1 - j]) % PRIME
            for j in range(n):
                if j < ahead and n - 1 - j < behind:
                    ats.append(j), rests.append(((heads[j] * powers[n - 1 - j] + tails[j + 1]) % PRIME).to_bytes(16, "big")), ids.append(i)
            whole = heads[n].to_bytes(16, "big")
            for j in range(n + 1):
                if j < ahead and n - j < behind:
                    ats.append(j), rests.append(whole), ids.append(i)
                if len(ats) > 100_000:
                    yield flush()
        yield flush()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) with a < b: ids of words (id, word) that differ by one inserted, deleted or replaced code point, each pair once."""
    bound_batches(words.sparkSession)
    short = words.where(F.char_length("word") <= LONGEST)
    found, depths, written = [], [], []
    for backwards in (False, True):
        depth, groups = _partitions(short, backwards, written)
        depths.append(depth.withColumnRenamed("depth", "behind" if backwards else "ahead"))
        found.append(groups.mapInArrow(_composition, "a long, b long"))
    # Almost always no word is left: prefixes and suffixes overlap in crowded partitions only.
    reach = words.join(depths[0], "id", "left").join(depths[1], "id", "left")
    beyond = F.char_length("word") >= LONGEST  # a word next to a longer one is compared with it at every place
    far = lambda c: F.when(~beyond, F.col(c))
    overlap = beyond | F.col("ahead").isNull() | F.col("behind").isNull() | (F.col("ahead") + F.col("behind") > F.char_length("word"))
    classes = reach.where(overlap).select("id", "word", far("ahead").alias("ahead"), far("behind").alias("behind")).mapInArrow(_places, "at long, rest binary, id long")
    members = classes.groupBy("at", "rest").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    pairs = members.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).where("a < b").distinct()
    both = pairs.join(words.select(F.col("id").alias("a"), F.col("word").alias("u")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("v")), "b")
    found.append(both.where(F.levenshtein("u", "v", 1) == 1).select("a", "b"))
    out = materialise(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "near")
    release(*written)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last. Each round doubles how far; a form is RATIO times as frequent, so there are few."""
    cur = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = cur.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(cur.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(cur)
        cur = moved
        if cur.where("moved").isEmpty():
            return cur.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words of at least six code points."""
    known = materialise(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_pairs(known.select("id", "word"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = known.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    joined = known.join(best, known["id"] == best["a"], "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    made = materialise(joined.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "forms")
    last = roots(made.where("form is not null").select("word", "form"))
    release(known, pairs)
    return made.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    """Spelling variants in all texts, letters dropped as the contract says.

    Null and empty texts have no words, a null id counts as empty text where letters are dropped. Rows that repeat an
    id or a text count as often as they occur. Of near words with the same count the first in code-point order is
    the form. Texts and runs may have any length; other columns are not read; an empty table gives none.
    """
    return grouped(vocabulary(docs))

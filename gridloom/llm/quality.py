"""Quality rules with thresholds adapted per language and source from mergeable quantile sketches.

A sketch counts a metric's values in buckets that keep the leading ``KEPT_BITS`` bits of an integer,
so a bucket is known within 1/128 of its value and two sketches merge by adding counts. Sketches are
plain rows (lang, source, metric, bucket, n): Spark builds them with partial aggregation, and those
of a language, or of everything, are sums of the finer ones. A group with fewer than ``MIN_GROUP``
documents takes its language's fences, a small language those of all documents.

No fence is a constant. Metrics that vary in every text (mean word length, share of letters) are fenced
``REACH`` interquartile ranges off their group's quartiles; those that are zero in most texts (copied lines,
repeated words) as far beyond the group's ``FAR`` hundredths as these lie beyond the median.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import bound_batches, forget, materialise, text_or_empty

KEPT_BITS = 8
REACH = 4
FAR = 99
MIN_GROUP = 50
#: Metric -> (measure, scale, measure to divide by): scale * a / b, rounded down.
RATIOS = {
    "word_length": ("word_chars", 100, "n_words"),
    "letters": ("n_letters", 1000, "word_chars"),
    "dup_word_lines": ("n_dup_lines", 1000, "n_word_lines"),
    "repeats": ("n_repeat_words", 1000, "n_words"),
}
#: Metric -> sides that are fenced: below or above the quartiles, or far above.
METRICS = {"word_length": ("low", "high"), "letters": ("low",), "dup_word_lines": ("far",), "repeats": ("far",)}
#: The pipeline's metrics.
CLOSE = METRICS
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(ws: list[bytes], size: int = WINDOW) -> int:
    """Words inside ``size``-word windows that occur twice or more, the first occurrence included."""
    n = len(ws) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
    keys = np.zeros(n, np.uint64)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(31)
    for k in range(size):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + spread[k : k + n]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    windows = [ids[i : i + size].tobytes() for i in at]
    seen = Counter(windows)  # hashes that clash are told apart here
    cover = np.zeros(len(ws) + 1, np.int64)
    for i, w in zip(at, windows):
        if seen[w] > 1:
            cover[i] += 1
            cover[i + size] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_word_lines of one whole text."""
    ws = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(ws), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ws), len(lines)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_letters"]


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then q_lang, q_source and the measures as q_*; null text has no words."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            texts = b.column(b.num_columns - 1)
            found = np.array([measure(x) for x in texts.to_pylist()], np.int64).reshape(-1, len(MEASURES) - 1)
            letters = pc.utf8_length(pc.replace_substring_regex(texts, r"\PL+", "")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x) for x in found.T), letters], out.names)

    src = docs.select(*keep, F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), text_or_empty(F.col("text")).alias("q_text"))
    out = StructType([*src.schema.fields[:-1], *[StructField(f"q_{x}", LongType()) for x in MEASURES]])
    return src.mapInArrow(run, out)


def failed_base() -> F.Column:
    return (F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words"))


def metric(name: str) -> F.Column:
    """A metric of RATIOS; an empty denominator counts as one."""
    a, scale, b = RATIOS[name]
    return F.floor(scale * F.col(f"q_{a}") / F.greatest(F.col(f"q_{b}"), F.lit(1))).cast("long")


def bucket(value: F.Column) -> F.Column:
    """The value with all but its leading KEPT_BITS bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - KEPT_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop).cast("long")


def sketches(measured: DataFrame, metrics: dict[str, tuple] = METRICS) -> DataFrame:
    """(lang, source, metric, bucket, n) over all documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(metric(k)).alias("bucket")) for k in metrics]))
    rows = measured.where(~failed_base()).select(F.col("q_lang").alias("lang"), F.col("q_source").alias("source"), each.alias("m"))
    return rows.groupBy("lang", "source", F.col("m.metric").alias("metric"), F.col("m.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame, by: list[str], tag: str, metrics: dict[str, tuple]) -> DataFrame:
    """(by..., docs, the fences <tag>_<side>_<metric>) from sketches merged over ``by``."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("docs"))
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= q * F.col("docs"), F.col("bucket")))
    found = ranked.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), quantile(25).alias("q1"), quantile(50).alias("q2"), quantile(75).alias("q3"), quantile(FAR).alias("top"))
    spread = REACH * (F.col("q3") - F.col("q1"))
    fence = {"low": F.col("q1") - spread, "high": F.col("q3") + spread, "far": 2 * F.col("top") - F.col("q2")}
    each = [F.max(F.when(F.col("metric") == k, fence[side])).alias(f"{tag}_{side}_{k}") for k, sides in metrics.items() for side in sides]
    return found.groupBy(*by).agg(F.max("docs").alias(f"{tag}_docs"), *each)


def thresholds(sketch: DataFrame, metrics: dict[str, tuple] = METRICS) -> DataFrame:
    """(lang, source, <side>_<metric>...) for each pair in the sketches; small ones take a coarser sketch's."""
    sketch = materialise(sketch, "sketch")
    names = [f"{side}_{k}" for k, sides in metrics.items() for side in sides]
    own = fences(sketch, ["lang", "source"], "own", metrics)
    of_lang = fences(sketch, ["lang"], "lang", metrics).withColumnRenamed("lang", "l")
    of_all = fences(sketch, [], "all", metrics).first()  # one row of numbers
    pick = lambda k: F.when(F.col("own_docs") >= MIN_GROUP, F.col(f"own_{k}")).when(F.col("lang_docs") >= MIN_GROUP, F.col(f"lang_{k}")).otherwise(F.lit(of_all[f"all_{k}"] if of_all else None))
    return own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")), "left").select("lang", "source", *[pick(k).alias(k) for k in names])


def outside(metrics: dict[str, tuple]) -> F.Column:
    """A metric lies beyond a fence of its group (columns of ``thresholds``)."""
    beyond = F.lit(False)
    for k, sides in metrics.items():
        for side in sides:
            fence = F.col(f"{side}_{k}")
            beyond = beyond | F.coalesce(metric(k) < fence if side == "low" else metric(k) > fence, F.lit(False))
    return beyond


def judge(docs: DataFrame, keep: list[str], metrics: dict[str, tuple] = METRICS) -> DataFrame:
    """Columns ``keep`` of every row with its measures (q_*), ``base_failed`` and ``kept``.

    A metric beyond a fence of its group rejects a document. Null languages and sources are groups of
    their own; documents that fail the base rules enter no sketch. Nothing is dropped here. ``keep`` must
    not hold the names of the added columns; ``passing`` takes any.
    """
    measured = materialise(measures(docs, keep), "measures")
    limits = materialise(thresholds(sketches(measured, metrics), metrics), "thresholds")
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    same = F.col("q_lang").eqNullSafe(F.col("t_lang")) & F.col("q_source").eqNullSafe(F.col("t_source"))
    return measured.join(limits, same, "left").select(*measured.columns, failed_base().alias("base_failed"), (~(failed_base() | outside(metrics))).alias("kept"))


def passing(docs: DataFrame, metrics: dict[str, tuple] = CLOSE) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns, whatever they are called.

    Null and empty texts fail the base rules; rows that repeat an id or are equal are judged each; an
    empty table stays empty.
    """
    held = [f"q_{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held)], F.col("lang"), F.col("source"), F.col("text"))
    return judge(own, held, metrics).where("kept").select(*held).toDF(*docs.columns)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row."""
    return judge(docs, ["doc_id"]).select("doc_id", *[F.col(f"q_{x}").alias(x) for x in MEASURES[:5]], "base_failed", "kept")

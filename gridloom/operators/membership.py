"""Splits, reconciliation and audits of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_membership(cells: DataFrame, registry: DataFrame, key: str = "parent_key") -> tuple[DataFrame, DataFrame]:
    """(sampled, unsampled) cells by the registry's keys."""
    keys = registry.select(key).where(F.col(key).isNotNull()).distinct()
    return cells.join(keys, key, "left_semi"), cells.join(keys, key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str], examples: int | None = 100) -> DataFrame:
    """Keys that occur more than once with their counts: the first ``examples`` in key order, None: all."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated if examples is None else repeated.orderBy(*keys).limit(examples)


def tagged_counts(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n_<tag>...): how often each table holds each key; one shuffle for all tables."""
    rows = None
    for tag, df in parts.items():
        one = df.select(key, F.lit(tag).alias("tag"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(*[F.sum((F.col("tag") == t).cast("long")).alias(f"n_{t}") for t in parts])


def membership_audit(cells: DataFrame, sampled: DataFrame, unsampled: DataFrame, key: str = "parent_key") -> DataFrame:
    """One row: totals, keys that are once on each side, missing and repeated ones."""
    n = tagged_counts({"all": cells, "sampled": sampled, "unsampled": unsampled}, key)
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return n.agg(
        total(F.col("n_all"), "all_rows"),
        total(F.col("n_sampled"), "sampled_rows"),
        total(F.col("n_unsampled"), "unsampled_rows"),
        total((F.col("n_all") == 1) & (F.col("n_sampled") + F.col("n_unsampled") == 1), "matched"),
        total((F.col("n_all") > 0) & (F.col("n_sampled") + F.col("n_unsampled") == 0), "missing"),
        total(F.greatest("n_all", "n_sampled", "n_unsampled") > 1, "duplicates"),
    )


def partition_mismatches(cells: DataFrame, sampled: DataFrame, unsampled: DataFrame, registry: DataFrame, key: str = "parent_key") -> DataFrame:
    """Keys whose counts break the rule: once in all, and once in exactly the side that the registry names."""
    n = tagged_counts({"all": cells, "sampled": sampled, "unsampled": unsampled, "registry": registry}, key)
    named = (F.col("n_registry") > 0).cast("long")
    return n.where(~((F.col("n_all") == 1) & (F.col("n_sampled") == named) & (F.col("n_unsampled") == 1 - named)))


def missing_and_unknown(members: DataFrame, parents: DataFrame, key: str = "parent_key") -> DataFrame:
    """(key, problem): parents that no member names, members without a parent."""
    missing = parents.select(key).distinct().join(members.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    unknown = members.select(key).distinct().join(parents.select(key), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    return missing.unionByName(unknown)


def against_canonical(child: DataFrame, canonical: DataFrame, key: str, checks: dict[str, str]) -> DataFrame:
    """One row: children with an unknown key, and those whose column differs, per ``checks`` name -> column."""
    known = canonical.select(key, F.lit(True).alias("known"), *[F.col(c).alias(f"canonical_{c}") for c in checks.values()])
    rows = child.join(known, key, "left")
    wrong = [F.coalesce(F.sum((F.col("known") & ~F.col(c).eqNullSafe(F.col(f"canonical_{c}"))).cast("long")), F.lit(0)).alias(n) for n, c in checks.items()]
    return rows.agg(F.coalesce(F.sum(F.col("known").isNull().cast("long")), F.lit(0)).alias("unknown_key"), *wrong)


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur exactly once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(columns..., side): rows of either table that the other lacks, repeats counted."""
    cols = left.columns
    return left.exceptAll(right.select(*cols)).withColumn("side", F.lit("left")).unionByName(right.select(*cols).exceptAll(left).withColumn("side", F.lit("right")))


def fold_leaks(folds: DataFrame) -> DataFrame:
    """(fold, patch_id, n_splits, n): members of more than one split of a fold, or listed twice."""
    return folds.groupBy("fold", "patch_id").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n")).where("n_splits > 1 or n > 1")


def report_difference(left: DataFrame, right: DataFrame, ignored: list[str] = ()) -> DataFrame:
    """(field, left, right) of two one-row reports where they differ; fields of one side only count as null."""

    def fields(df: DataFrame, side: str) -> DataFrame:
        names = [c for c in df.columns if c not in ignored]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(side)) for c in names]))
        return df.select(pairs.alias("p")).select("p.*")

    return fields(left, "left_value").join(fields(right, "right_value"), "field", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """Work whose keys no finished record names; a retryable error is not finished."""
    return wanted.join(done.where(F.col(status) != "retryable_error").select(*keys), keys, "left_anti")


def group_counts(df: DataFrame, by: list[str | Column]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


#: Rows whose hashes one task puts in order; the number of buckets grows with the table.
DIGEST_ROWS = 100_000
#: Children of a node of the digest's tree.
DIGEST_FAN = 4096


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (digest, n): order-free SHA-256 of a table.

    Rows are hashed, and equal hashes are counted first, so that a row that occurs very often is one entry. Hashes are dealt by
    their first bits to as many buckets (a power of two) as there are ``DIGEST_ROWS`` of them; a bucket's hashes,
    each followed by ``x`` and its count where that is not one, are put in order and hashed, and so are the buckets' hashes, a
    fixed number at a time, up to one. No task holds more than a bucket, and equal tables have equal
    digests however they are partitioned.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    hashes = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("times"))
    whole = hashes.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()
    total, buckets = whole["n"], 1
    while buckets * DIGEST_ROWS < whole["entries"]:
        buckets *= 2
    at = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    placed = hashes.select(at.alias("at"), F.when(F.col("times") == 1, F.col("h")).otherwise(F.concat("h", F.lit("x"), F.col("times").cast("string"))).alias("h"))
    level = placed.groupBy("at").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    while buckets > 1:
        buckets = -(-buckets // DIGEST_FAN)
        parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"])
        level = level.groupBy(F.floor(F.col("at") / DIGEST_FAN).alias("node")).agg(F.sha2(F.concat_ws("", parts), 256).alias("h")).withColumnRenamed("node", "at")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return level.agg(F.coalesce(F.max("h"), empty).alias("digest")).withColumn("n", F.lit(total).cast("long"))

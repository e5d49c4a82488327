"""Validity, scaling and masking of pixels, and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import stable_unit_hash

#: Scene classes of clear land, water and the like; fixed values.
S2_CLEAR = (4, 5, 6, 7, 11)
QA_BITS = 31
LANDSAT_SCALE, LANDSAT_OFFSET = 0.0000275, -0.2


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def qa_clear(source: Column, qa: Column) -> Column:
    """The QA rule of a source alone: S2 class, Landsat's low five bits; others have none."""
    return F.when(source == "s2", qa.isin(*S2_CLEAR)).when(source == "landsat", qa.cast("int").bitwiseAND(QA_BITS) == 0).otherwise(F.lit(True))


def valid_pixel(source: Column, band0: Column, qa: Column) -> Column:
    """Finite and nonzero on band 0, and clear by the source's QA rule."""
    return F.coalesce(finite(band0) & (band0 != 0) & qa_clear(source, qa), F.lit(False))


def landsat_scaled(value: Column, is_qa: Column, valid: Column) -> Column:
    """Reflectance of valid pixels; QA and invalid pixels stay as they are."""
    return F.when(~is_qa & valid, value * LANDSAT_SCALE + LANDSAT_OFFSET).otherwise(value)


def z_score(value: Column, mean: Column, std: Column, valid: Column) -> Column:
    return F.when(valid, F.try_divide(value - mean, std)).otherwise(0.0)


def clipped_sigmoid(x: Column, limit: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))))


def l2_normalised(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def month_number(date: Column) -> Column:
    """YYYYMM of a date."""
    return (F.year(date) * 100 + F.month(date)).cast("int")


def month_of_name(name: Column) -> Column:
    """YYYYMM of the first run of exactly eight digits in a file name, else 0."""
    run = F.regexp_extract(name, r"(?<!\d)(\d{8})(?!\d)", 1)
    return F.when(run == "", 0).otherwise(F.substring(run, 1, 6).cast("int"))


def month_index(month: Column, first: Column | int) -> Column:
    """Months since ``first``; both are YYYYMM."""
    first = first if isinstance(first, Column) else F.lit(first)
    return ((F.floor(month / 100) - F.floor(first / 100)) * 12 + (month % 100 - first % 100)).cast("int")


def month_interval(month: Column) -> Column:
    """struct(first, last): the first and the last second of a YYYYMM month, as ISO texts."""
    day = F.to_date(month.cast("string"), "yyyyMM")
    return F.struct(F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'").alias("first"), F.date_format(F.last_day(day), "yyyy-MM-dd'T'23:59:59'Z'").alias("last"))


def month_list(first: Column, last: Column) -> Column:
    """YYYYMM numbers from ``first`` to ``last`` date."""
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), month_number)


def dropped(seed: int, kind: str, key: Column, rate: float) -> Column:
    """Seeded dropout: true for about ``rate`` of all keys, the same ones in every run."""
    return stable_unit_hash(seed, F.concat(F.lit(f"{kind}:"), key.cast("string"))) < rate


def block_key(sample: Column, row: Column, col: Column, size: int) -> Column:
    return F.concat_ws(":", sample.cast("string"), F.floor(row / size).cast("string"), F.floor(col / size).cast("string"))

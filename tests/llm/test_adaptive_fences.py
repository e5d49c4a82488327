"""Quality fences are of the data: they differ by group, and constants in their place reject other documents."""

from pyspark.sql import functions as F

from gridloom.llm import quality


def test_fences_differ_by_group_and_decide(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    measured = quality.measures(docs, ["doc_id"]).cache()
    limits = quality.thresholds(quality.sketches(measured)).collect()
    assert len(limits) == 80
    for name in ("low_word_length", "high_word_length", "low_letters", "far_dup_word_lines"):
        assert len({r[name] for r in limits}) > 5, name
    got = quality.judge(docs, ["doc_id"]).where("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.98 and share[0] < 0.05
    measured.unpersist()


def test_sketches_merge_by_adding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = quality.sketches(quality.measures(docs, ["doc_id"]))
    halves = [quality.sketches(quality.measures(docs.where(f"doc_id % 2 = {i}"), ["doc_id"])) for i in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))


def test_clashing_columns_are_kept(spark):
    text = " ".join(f"word{chr(97 + i)}" for i in range(26))
    rows = [(i, text if i else "short", "en", "s0", i * 2, "x", "y") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, q_lang string, q_0 string")
    out = quality.passing(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.kept, r.q_lang, r.q_0) for r in out.collect()) == [(i, i * 2, "x", "y") for i in range(1, 5)]

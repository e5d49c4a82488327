"""Every operator and stage gives the same rows whatever other columns there are, their names those of own ones included."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import bpe, embdedup, lm, packing, pii, quality, simhash, tokenbin, toxicity, urlgraph

NAMES = ["row", "id", "chunk", "levels", "held_out", "score", "kept", "q_lang", "q_0", "base_failed", "near_row", "pii_row", "pii_text", "pii_cuts", "fp0", "component_id", "label", "part", "seq", "term", "grp", "doc_tokens", "crcs"]


def crowded(df):
    """Further columns, null in every other row."""
    odd = F.pmod(F.coalesce(df[df.columns[0]], F.lit(0)), F.lit(2)) == 1
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.when(odd, "x").alias(c) for c in NAMES if c not in have])


def same(a, b):
    columns = [c for c in a.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


@pytest.mark.parametrize("operator", [pii.report, lm.scores, tokenbin.token_table, simhash.component_table, quality.verdicts, bpe.digests, packing.windows], ids=lambda f: f.__name__)
def test_documents(operator, odd_docs):
    same(operator(odd_docs), operator(crowded(odd_docs)))


def test_toxicity(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, toxic int")
    same(toxicity.predictions(odd_docs, labels), toxicity.predictions(crowded(odd_docs), crowded(labels)))


def test_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    wide = crowded(vectors).withColumns({c: F.lit("y") for c in ("key", "n", "cell", "block", "a", "b")})
    same(embdedup.neighbours(vectors), embdedup.neighbours(wide))
    pages = spark.createDataFrame([(1, "http://x.com/de/", "<a href='//y.net/'>"), (2, None, None), (2, "http://y.net/", "")], "page_id long, url string, html string")
    same(urlgraph.verdicts(pages), urlgraph.verdicts(crowded(pages).withColumns({c: F.lit("y") for c in ("host", "path", "rule", "verdict", "by_rule", "bad_host", "src", "link")})))


def test_stages_keep_them(spark, odd_docs):
    docs, wide = odd_docs, crowded(odd_docs)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs, wide = stage(spark, docs, "/root/testdata/sf0.001"), stage(spark, wide, "/root/testdata/sf0.001")
        assert wide.columns == crowded(odd_docs).columns
        same(docs, wide.select(*docs.columns))
        same(wide, crowded(wide.select(*docs.columns)))

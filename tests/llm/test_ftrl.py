"""FTRL toxicity scores against a plain model with dictionaries, row after row."""

import math

import pytest
import xxhash

from gridloom.llm import toxicity
from tests.llm.test_texts import fold, words

M = 2**64 - 1


def mix(a, b):
    x = (a * 0x9E3779B97F4A7C15 & M) ^ (b + 0x632BE59BD9B4E019 & M)
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & M
    return x ^ x >> 32


def slots(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 7) for w in words(text)]
    grams = h + [mix(h[i], h[i + 1 + k] + k & M) for k in range(3) for i in range(len(h) - 1 - k)]
    return sorted({0} | {g >> 44 for g in grams})


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def weight(z, n, i):
    return 0.0 if abs(z.get(i, 0.0)) <= 4.0 else (math.copysign(4.0, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 2.0 + 0.1)


def fitted(rows):
    z, n = {}, {}
    for _ in range(2):
        for _, text, label in rows:
            at = slots(text)
            w = {i: weight(z, n, i) for i in at}
            g = sigmoid(sum(w.values())) - label
            for i in at:
                more = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(more) - math.sqrt(n.get(i, 0.0))) / 2.0 * w[i]
                n[i] = more
    return lambda text: sigmoid(sum(weight(z, n, i) for i in slots(text)))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_scores_equal_a_plain_model(sf, spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    learnt = [(r.doc_id, texts[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id in texts and fold(r.doc_id, 5)]
    learnt.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & M)
    model = fitted(learnt)
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(model(texts[r.doc_id]), abs=1e-5) and r.predicted == (r.score >= 0.5)


def test_stage_keeps_clashing_columns_and_every_row_without_labels(spark, no_docs):
    docs = spark.createDataFrame([(1001, "nice text", 0.9, "k"), (1001, "nice", 0.1, None)], "doc_id long, text string, score double, score_ string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(map(str, toxicity.clean(docs, none).collect())) == sorted(map(str, docs.collect()))
    some = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    more = docs.unionByName(spark.createDataFrame([(i, f"bad evil {i}" if i % 4 == 0 else f"nice day {i}", 0.5, "s") for i in range(80)], docs.schema))
    out = toxicity.clean(more, some)
    assert out.columns == docs.columns and {r.score for r in out.collect()} == {0.9, 0.1, 0.5} and out.count() == 62
    assert toxicity.clean(no_docs, some).count() == 0

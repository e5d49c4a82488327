import pytest

import corpus_pipeline
from gridloom.llm import simhash
from tests.llm.test_texts import base, components, fingerprint, repeated, words

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    ws = words(text)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert got.keys() <= kept.keys()
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            assert not [i for i in kept.keys() - got.keys() if labels.get(i) == 0]
        if name == "quality":
            fails = {i for i, r in kept.items() if len(words(r.text)) < 20 or 100 * repeated(words(r.text)) > 30 * len(words(r.text))}
            assert not fails & got.keys()
        if name == "simhash":
            sets = {i: shingles(r.text) for i, r in kept.items()}
            ids = sorted(kept)
            near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            assert got.keys() == set(components(near, ids).values())
        if name == "pii":
            assert got.keys() == kept.keys()
            assert all(got[i].text == r.text for i, r in kept.items() if not base(r.text))
            assert not any(base(r.text) for r in got.values())
        kept, docs = got, out


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len({r.doc_id for r in rows}) < spark.read.parquet(f"{SMALL}/documents.parquet").count()


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_stages_take_odd_and_empty_tables(which, request, spark):
    docs = request.getfixturevalue(which)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert which == "odd_docs" or docs.count() == 0


def test_near_duplicates_of_five_word_shingles(spark):
    text = [f"w{i * 31 % 997}" for i in range(400)]
    other = [f"v{i * 17 % 991}" for i in range(400)]
    near = text.copy()
    near[100], near[300] = "changed", "too"
    rows = [(5, " ".join(text)), (3, " ".join(near)), (9, " ".join(text)), (8, " ".join(other)), (8, " ".join(text)), (None, " ".join(near))]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in got) == [(3, "w0"), (8, "v0")]
    assert fingerprint("one two three") == fingerprint("ONE\ttwo three")

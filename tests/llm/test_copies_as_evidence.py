from collections import Counter

from gridloom.llm import pii
from tests.llm.test_disclosure import TERM, flagged

FAR = " ".join(f"common{k}" for k in range(30))
TEXTS = [f"{FAR} zebulon at q@w.example.org" for _ in range(8)] + [f"{FAR} said here {i}" for i in range(60)]
VARIED = [f"{FAR} quagga via r@v.example.org y{i}" for i in range(6)] + [f"{FAR} quagga via r@v.example.org y0"] * 5


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found_terms(docs):
    return {r.term: r.replacement for r in pii.disclosing(docs, pii.materialise(pii.located(docs), "located"), distinct=True).collect()}


def test_counts_of_distinct_texts_equal_plain_ones(spark, real_docs):
    texts = [r.text or "" for r in real_docs.collect()] + TEXTS + VARIED
    distinct = sorted(set(texts))
    spread = Counter(t for text in distinct for t in {m[0].lower() for m in TERM.finditer(text)})
    want = flagged(distinct, sum(n > 1 for n in spread.values()))
    assert "quagga" in want and "zebulon" not in want and found_terms(table(spark, texts)) == want


def test_copies_of_rows_flag_nothing_new(spark):
    before = found_terms(table(spark, TEXTS + VARIED))
    assert "quagga" in before and found_terms(table(spark, VARIED * 3 + TEXTS + TEXTS[:8] * 4 + VARIED)) == before


def test_spans_stand_in_every_copy(spark):
    rows = pii.report(table(spark, TEXTS + VARIED), distinct=True).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert len(rows) == len(spans) == len(TEXTS + VARIED)
    assert not any("term:" in spans[i] for i in range(len(TEXTS)))
    assert all("term:" in spans[i] for i in range(len(TEXTS), len(spans)))
    assert pii.report(table(spark, TEXTS).limit(0), distinct=True).count() == 0

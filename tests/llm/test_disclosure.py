"""Disclosing terms of PII against a plain version that counts with dictionaries."""

import math
import re
from collections import Counter, defaultdict

import pytest

from gridloom.llm import pii
from tests.llm.test_texts import base, key

TERM = re.compile(r"[^\W_]+")


def group_of(kind, value):
    number = re.sub("[^0-9]", "", value)
    return [value[value.find("@") :].lower(), value[: value.rfind(".") + 1], number[:6], "+" + number[:-4]][kind]


def term_class(t):
    return "number" if t.isdecimal() else "mixed" if re.search("[0-9]", t) else "word"


def flagged(texts, distinct):
    """term -> replacements of the entities that it discloses."""
    n = len(texts)
    entity_docs, term_docs, both, class_docs, class_both = Counter(), Counter(), Counter(), Counter(), Counter()
    for text in texts:
        terms = {m[0].lower() for m in TERM.finditer(text)}
        term_docs.update(terms)
        class_docs.update({term_class(t) for t in terms})
        spans = base(text)
        found = {(k, text[a:b]) for a, k, b in spans}
        found |= {(k + 4, group_of(k, v)) for k, v in found}
        entity_docs.update(found)
        clear = {m[0].lower() for m in TERM.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in spans)}
        both.update((e, t) for e in found for t in clear)
        class_both.update((e, c) for e in found for c in {term_class(t) for t in clear})
    out = defaultdict(set)
    for (e, t), shared in both.items():
        information = math.log2(n / entity_docs[e])
        if shared < 2 or information <= 0 or shared * information <= math.log2(distinct):
            continue
        if math.log2(shared * n / (entity_docs[e] * term_docs[t])) / information >= 0.9:
            c = term_class(t)
            general = math.log2(class_both[e, c] * n / (entity_docs[e] * class_docs[c])) / information >= 0.9
            out[t].add("" if general else f"<{c}>")
    return {t: min(x) for t, x in out.items()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_term_spans_equal_plain_counts(sf, spark):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    texts = [r.text or "" for r in rows]
    spread = Counter(t for text in texts for t in {m[0].lower() for m in TERM.finditer(text)})
    distinct = sum(n > 1 for n in spread.values())
    terms = flagged(texts, distinct)
    want = []
    for r in rows:
        spans = base(r.text or "")
        every = [(a, k, b) for a, k, b in spans]
        every += [(m.start(), 4, m.end()) for m in TERM.finditer(r.text or "") if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, _, b in spans)]
        want.append((r.doc_id, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(every))))
    got = [(r.doc_id, r.spans) for r in pii.report(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sf == "0.001" or sum("term" in s for _, s in got) > 5


def test_own_column_names_do_not_clash(spark):
    rows = [(i, f"call zebulon at q@w.example.org from {i}", 7, "u", 3) for i in range(4)] + [(9, None, 8, "v", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_row int, pii_cuts string, pii_base int")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "call zebulon at <email> from 2" and (got[2].pii_row, got[2].pii_cuts, got[2].pii_base) == (7, "u", 3)
    assert got[9].text is None and pii.report(docs).count() == 5

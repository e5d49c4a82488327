from gridloom.llm import pii


def test_disclosing_terms_are_replaced_wherever_they_stand(spark):
    far = " ".join(f"common{k}" for k in range(30))
    shown = [(i, f"Zebulon said {far} call zebulon at q@w.example.org x{i}", 0) for i in range(4)]
    shown += [(i, f"quagga here {far} mail r@v.example.org y{i}", 0) for i in range(4, 24)]
    rest = [(i, f"{far} said here call at mail example org {i}", 0) for i in range(100, 160)]
    alone = [(200, f"{far} quagga alone", 0), (201, None, 0)]
    docs = spark.createDataFrame(shown + rest + alone, "doc_id long, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    texts = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(texts) == len(shown + rest + alone)
    assert texts[0].text == f"<word> said {far} call <word> at <email> x0" and texts[0].n_chars == len(texts[0].text)
    assert spans[0].startswith("term:0:7,term:") and spans[0].count("term:") == 2
    assert texts[5].text == f"<word> here {far} mail <email> y5"
    assert texts[200].text == f"{far} <word> alone" and spans[200] == f"term:{len(far) + 1}:{len(far) + 7}"
    assert texts[110].text == rest[10][1] and texts[201].text is None

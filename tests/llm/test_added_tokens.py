from gridloom.llm import bpe

TEXTS = ["x<|endoftext|>", "one <|endoftext|> two", "a<|endoftext|>\nb", "a  <|endoftext|>\t\n b", "<|endoftext|>", "plain words |> here", "<|endoftext|><|endoftext|> <|endoftext", "", "don't<|endoftext|> é<|endoftext|>"]


def test_added_tokens_stay_whole_before_space_line_end_and_end():
    enc = bpe.encoder(bpe.default_tokenizer())
    want = enc.plain(TEXTS)
    assert want[0] == [87, 50256]
    assert [x.tolist() for x in enc.encode(TEXTS)] == want
    for text in (" ".join(TEXTS) * 20, "a<|endoftext|> b\n" * 90):
        for leaf in (3, 50, 700):
            assert enc.concatenate(enc.encode(bpe.leaves(text, leaf))).tolist() == enc.plain([text])[0]


def test_digests_of_documents_with_added_tokens(spark):
    import hashlib

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.ids_sha256 for r in bpe.digests(docs).collect()}
    ids = bpe.encoder(bpe.default_tokenizer()).plain(TEXTS)
    assert got == {i: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for i, x in enumerate(ids)}

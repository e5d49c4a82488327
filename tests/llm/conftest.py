import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(20_000))


def odd_rows():
    """Null, empty, blank, long, repeated and unusual texts; repeated and null ids."""
    texts = [
        None,
        "",
        " \t\n",
        "one",
        "Two words",
        "ÀÉ mixed Case text\x0bwith\x1codd  spaces\r\n\nand <|endoftext|> marks ### $$ a|b",
        LONG,
        LONG,
        LONG + " tail",
        "x" * 40_000,
        "don't won't 日本語テキスト é́ 12 345",
        "a@b.co, a@b.co.d@e.fr 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (386) 555-3733 +12 345",
        "card 4111111111111111 mail me.x+y%z@mail-1.example.com. +49 (0) 89.1234-567) ok +1",
        "the same line\nthe same line\nother\n\n\nthe same line\n" + "a b c d e f g h " * 3,
        "a b c d e f g h " * 30,
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", "s1", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return rows + [(7, LONG, "en", "s0", 1), (None, "no id here", None, None, None), (None, "no id here", None, None, None), (-5, "Two words", "en", "s0", 9)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

import random

import pytest

from gridloom.llm import simhash
from tests.llm.test_templated_texts import templated


@pytest.fixture
def named(monkeypatch):
    """Rows of each round's table of index entries with their components."""
    plain, rows = simhash.materialise, []

    def counted(df, name):
        out = plain(df, name)
        if name == "named":
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    return rows


def test_lists_of_the_same_members_are_read_once(spark, named):
    draw = random.Random(4)
    rows = []
    for _ in range(40):
        text = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text[:-1], "changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(range(0, 80, 2))
    assert named == [80]


def test_rounds_that_link_little_give_way_to_blocks(spark, named):
    docs = spark.createDataFrame(templated(120, 75), "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs).count() == 120
    assert len(named) == 1


def test_a_list_within_one_component_is_not_read_again(spark, named, monkeypatch):
    """Twenty groups of near copies, done with after the first comparison, beside texts of one template, which stay open."""
    monkeypatch.setattr(simhash, "PAIRS_PER_ENTRY", 0)
    draw = random.Random(7)
    rows = templated(20, 75)
    for _ in range(20):
        text = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for copy in range(8):
            at = draw.randrange(200)
            rows.append((len(rows), " ".join([*text[:at], f"copy{copy}", *text[at + 1 :]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {*range(20), *range(20, 180, 8)}
    assert len(named) > 1 and all(later <= named[0] - 160 for later in named[1:])

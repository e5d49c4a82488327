import corpus_pipeline
from gridloom.llm import quality


def test_repeats_and_duplicate_lines_fences_reject_outliers_that_the_base_rules_pass(spark):
    plain = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, "\n\n".join(plain(10 * i + k, 30) for k in range(5)), "en", "s0") for i in range(200)]
    eight = plain(9001, 8)
    rows.append((500, f"{eight} {plain(9002, 20)} {eight} {plain(9003, 30)}", "en", "s0"))  # 16 of 66 words
    copies = "\n\n".join(["one short line"] * 6)
    rows.append((501, f"{copies}\n\n{plain(9004, 100)}", "en", "s0"))  # 5 of 7 lines with a word, 18 of 118 words
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    metrics = [quality.metric(k).alias(k) for k in ("dup_word_lines", "repeats")]
    got = {r.doc_id: r for r in quality.judge(docs, ["doc_id"], quality.CLOSE).select("doc_id", "base_failed", "kept", *metrics).collect()}
    assert (got[500].dup_word_lines, got[500].repeats) == (0, 242)
    assert (got[501].dup_word_lines, got[501].repeats) == (714, 152)
    assert not any(r.base_failed for r in got.values())
    assert {r.doc_id for r in corpus_pipeline.of_quality(spark, docs, "").collect()} == set(range(200)) == {i for i, r in got.items() if r.kept}


def test_blank_lines_do_not_dilute_copied_lines(spark):
    plain = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, plain(i, 40), "en", "s0") for i in range(200)] + [(500, "\n\n\n\n".join(["ab cd"] * 2 + [plain(700 + k, 10) for k in range(48)]), "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.judge(docs, ["doc_id"], quality.CLOSE).where("doc_id = 500").select(quality.metric("dup_word_lines").alias("x")).first().x == 20

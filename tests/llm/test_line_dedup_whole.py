"""Line dedup of lines of any length."""

from millrace.llm import line_dedup

SCHEMA = "doc_id long, text string"


def dedup(spark, texts):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}


def test_short_lines_recur(spark):
    lines = ["Read more", "続きを読む。", "Page {}", " \t", ""]
    texts = ["\n".join([*lines, f"own{chr(97 + i)}", f"Own {chr(97 + i)}"]).format(i) for i in range(3)]
    got = dedup(spark, [*texts, "Read less\nMore", "twice only", "twice only"])
    for i in range(3):
        assert got[i] == (7, 3, f" \t\n\nown{chr(97 + i)}\nOwn {chr(97 + i)}")
    assert got[3] == (2, 0, "Read less\nMore")
    assert got[4] == got[5] == (1, 0, "twice only")


def test_a_common_beginning_is_no_template(spark):
    texts = ["Of the anshin.", "Of the therwhre.", "Of the atealy.", "We saw a cat there", "We saw one dog there", "We saw his new car"]
    got = dedup(spark, texts)
    assert all(got[i] == (1, 0, t) for i, t in enumerate(texts))


def test_enough_places_after_the_beginning_are_a_template(spark):
    texts = [f"Of the {w} at 1{i} noon today" for i, w in enumerate(["ann", "bob", "cyd"])]
    assert all(x == (1, 1, "") for x in dedup(spark, texts).values())

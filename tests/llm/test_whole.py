"""Short copies, and targets just below a whole number of epochs."""

import pytest

from brevia.llm import chunks, mixing


def test_short_copies_are_removed_whole(spark):
    short = ["A short notice.", "One line of some forty bytes, repeated.", "x", "Ninety-nine bytes " * 5]
    rows = [(10 * i + j, t) for i, t in enumerate(short) for j in range(3)] + [(100, "Only once."), (101, ""), (102, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["text"] for r in chunks.without_repeated_chunks(d).collect()}
    assert got == {i: "" if i < 100 and i % 10 else t for i, t in rows}


@pytest.mark.parametrize(("total", "want"), [(0.996, 100), (0.994, 99), (1.997, 200), (1.0, 100), (0.004, 0)])
def test_mix_where_the_target_is_just_below_whole_epochs(spark, total, want):
    d = spark.createDataFrame([(i, "one two three four five six seven eight nine ten", "a") for i in range(10)], "doc_id long, text string, source string")
    rows = mixing.mix(d, total=total).collect()
    assert rows[0]["source_size"] == 100 and rows[0]["target"] == pytest.approx(100 * total)
    assert sum(r["taken"] for r in rows) == want and len(rows) == 10

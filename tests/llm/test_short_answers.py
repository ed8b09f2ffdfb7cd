"""Benchmark items whose answers have too few shingles to outlast a changed word."""

from millrace.llm.decontamination import contaminated, decontaminated


def test_a_short_answer_with_one_changed_word_is_held(spark):
    question = " ".join(f"q{i}" for i in range(34)) + "."
    bench = spark.createDataFrame([(7, f"{question} the animal leaps over a lazy dog")], "item_id long, text string")
    pad = "pad " * 80
    docs = [
        (1, f"{pad}{question} the animal leaps over a lazy dog {pad}"),
        (2, f"{pad}{question} the animal leaps above a lazy dog {pad}"),
        (3, f"{pad}{question} {pad}"),
        (4, f"{pad}{question} the dog leaps under a tall fence {pad}"),
        (5, f"the animal leaps above a lazy dog {pad}{question} {pad}"),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: round(r.answer_overlap, 2) for r in contaminated(docs, bench).collect()}
    assert got == {1: 1.0, 2: 0.86}
    assert sorted(r.doc_id for r in decontaminated(docs, bench).collect()) == [3, 4, 5]

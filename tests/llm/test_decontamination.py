"""Short benchmark items, held whole by a document."""

from __future__ import annotations

from gridclime.llm import decontaminate

ITEMS = [
    (1, "What is the capital of France?"), (2, "Who wrote the novel Moby Dick, and in what year?"), (3, "too short item here"),
    (4, "What is the capital of France?"), (5, " ".join(f"w{i}" for i in range(20))),
]
DOCS = [
    (1, "We asked: what IS the capital of france -- nobody knew"), (2, "what is the capital city of France"), (3, "too short item here"),
    (4, "x " * 50 + "Who wrote the novel Moby Dick and in what year? What is the capital of France? What is the capital of France?"),
    (5, "what is the capital"), (6, "of France what is the capital"), (7, None), (8, ""), (9, " ".join(f"w{i}" for i in range(20))),
    (None, "what is the capital of france"),
]


def test_short_items_are_found_whole(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert not decontaminate.contaminated(docs.where("doc_id = 2"), items).collect()
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words, r.n_same) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {
        (1, 1): (2, 6, 6), (1, 4): (2, 6, 6), (4, 2): (50, 10, 10), (4, 1): (60, 6, 6), (4, 4): (60, 6, 6), (9, 5): (0, 20, 20),
        (None, 1): (0, 6, 6), (None, 4): (0, 6, 6),
    }

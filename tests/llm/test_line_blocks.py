"""Deleted lines against brute force over all earlier documents."""

import random

import pytest

from daybook.llm import line_dedup


def brute(texts, least=10):
    """Texts without the lines of every common run of ``least`` words with any earlier document."""
    split = [t.split("\n") for t in texts]
    out = []
    for d, lines in enumerate(split):
        gone = set()
        for other in split[:d]:
            for i in range(len(lines)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(lines) and j + n < len(other) and lines[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


A, B, C = "a b c d e f", "g h i j k l", "m n o p q r"
LONG = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize(
    "texts",
    [
        [A, B, f"{A}\n{B}", f"{A}\n{B}"],
        [f"{A}\n{B}\nx\n{A}\n{B}\ny", f"new\n{A}\n{B}\nother"],
        [f"{B}\nx\n{A}", f"{A}\n{B}\n{C}", f"p\n{A}\n{B}\n{C}\nq"],
        ["\n".join("abcdefghijkl"), "head\n" + "\n".join("abcdefghijk") + "\ntail"],
        [f"\n{LONG}\n\nend", f"start\n{LONG}\n\nstop", f"{LONG}"],
    ],
)
def test_blocks_of_any_earlier_document_go(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)
    assert brute(texts) != texts


def test_random_documents_equal_brute_force(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefgh", k=n)) for n in (0, 1, 1, 2, 3, 4, 6, 9, 10, 14)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)

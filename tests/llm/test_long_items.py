"""Benchmark items of extreme length: exact counts, no overflow, no quadratic work."""

import random

import pytest
import xxhash

from daybook.llm import decontaminate


def fingerprint(words):
    grams = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(grams))
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("kind", ["distinct", "equal", "two"])
def test_items_of_72_000_words(spark, kind):
    rng = random.Random(1)
    words = {
        "distinct": [f"w{rng.randrange(10**6)}" for _ in range(72_000)],
        "equal": ["same"] * 72_000,
        "two": ["a", "b"] * 36_000,
    }[kind]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "five short words are here now")], "item_id long, text string")
    if kind != "two":
        assert decontaminate.benchmark_items(items).where("item_id = 1").first().fp == fingerprint(words)
    near = [*words[:30_000], "other", *words[30_001:]]
    texts = [(1, " ".join(["before", *near, "after"])), (2, "nothing of it " * 50), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 1)]
    assert found[0].similarity == pytest.approx((71_996 - 5) / (71_996 + 5), abs=1e-4)


def test_shingles_are_numbered_by_occurrence(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b", "a"],), (["x"],), (["y", "z"],)], "g array<string>")
    got = [sorted(r[0]) for r in df.select(decontaminate._numbered("g")).collect()]
    assert got == [["a #1", "a #2", "b #1", "b #2", "b #3"], ["x #1"], ["y #1", "z #1"]]

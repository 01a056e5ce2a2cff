"""Near copies against brute force over all pairs, and the stage of the pipeline that drops them."""

import random

import pytest

import corpus_pipeline
from daybook.llm import near_copies


def edited(rng, base, n):
    words = list(base)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.random()}"
    return words


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def texts():
    """Short, medium and long near copies with few edits, a boilerplate, a chain and awkward texts."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    found = []
    for size, edits in ((50, 1), (60, 1), (120, 2), (400, 6), (400, 9), (30, 1)):
        base = fresh(size)
        found += [base, edited(rng, base, edits), edited(rng, base, edits), [w.upper() for w in base]]
    group = fresh(200)
    found += [edited(rng, group, rng.randrange(6)) for _ in range(40)]
    common = fresh(40)
    found += [[*common, *fresh(rng.randrange(4, 30))] for _ in range(30)]
    chain = fresh(150)
    found += [[*chain[i * 9 :], *fresh(i * 9)] for i in range(8)]
    found += [fresh(n) for n in range(1, 30)]
    rng.shuffle(found)
    return [*map(" ".join, found), None, "", "one", "One", "a b c d", "a b c e"]


def brute(texts):
    sets = list(map(shingles, texts))
    names = list(range(len(texts)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if len(x & y) >= 0.8 * len(x | y):
                names = [names[b] if n == names[a] else n for n in names]
    return sorted(min(i for i, n in enumerate(names) if n == name) for name in set(names))


@pytest.mark.parametrize("small, rounds, block", [(16, 3, 1024), (2, 1, 8), (2, 0, 8)])
def test_keep_one_equals_brute_force(spark, texts, monkeypatch, small, rounds, block):
    monkeypatch.setattr(near_copies, "SMALL_KEY", small)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute(texts)


def test_pipeline_stage_drops_a_copy_with_one_changed_word(spark):
    base = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:20], "changed", *base[21:]])), (3, " ".join(base[::-1]))]
    rows += [(None, "x y"), (None, "x y"), (4, None), (5, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in kept if x) == [1, 3, 4, 5] and kept.count(None) == 2


def test_rows_of_one_doc_id_are_judged_by_text(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (1, "a b c")], "doc_id long, text string")
    assert sorted(r.text for r in near_copies.keep_one(docs).collect()) == ["a b c", "d e f"]


def test_texts_of_near_fingerprints_link_beyond_the_shingle_similarity(spark):
    from daybook.llm import simhash

    rng = random.Random(11)
    fresh = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(5)]
    # repeats count in a fingerprint but not in a set: a long refrain outweighs what differs
    refrain = " ".join(["to be or"] * 300)
    texts = [*fresh[:3], f"{refrain} {fresh[3]}", f"{refrain} {fresh[4]}", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alike = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert alike[4] == 3 and len(shingles(texts[3]) & shingles(texts[4])) < 0.8 * len(shingles(texts[3]) | shingles(texts[4]))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 1, 2, 3, 5]


def test_common_shingles_are_found_from_the_same_count_on_at_any_size(spark):
    rows = [(i, f"one two three four five x{i}a x{i}b x{i}c x{i}d x{i}e") for i in range(400)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    padded = few.unionByName(spark.range(20_000).selectExpr("id + 1000 AS doc_id", "concat('y', id, ' z', id) AS text"))
    least = {frozenset(near_copies._common(docs, 5)[0].tolist()) for docs in (few, padded)}
    assert len(least) == 1 and len(min(least)) == 1

"""Toxic texts that few labelled ones resemble are dropped, and stages that are not read any more leave the disk."""

import os
import random

from daybook.llm import near_copies, toxicity


def test_cutoff_is_where_held_out_rows_tell_toxic_texts_best(spark):
    rng = random.Random(5)
    slurs = [f"slur{c}" for c in "abcd"]

    def row(i):
        words = [f"w{rng.choice('abcdefghijklmnopqrst')}" for _ in range(20)]
        return i, " ".join([*words, slurs[i // 10 % 4]] if i % 10 == 0 else words)

    docs = spark.createDataFrame([row(i) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    settings = toxicity.Settings(vocabulary=4, penalty=0.05)
    found = toxicity.toxicity(docs, labels, settings).collect()
    toxic = [r for r in found if r.doc_id % 10 == 0]
    assert min(r.p_toxic for r in toxic) < 0.5
    assert {r.doc_id for r in found if r.toxic} == {r.doc_id for r in toxic}
    assert toxicity.keep_clean(docs, labels, settings).count() == 540


def test_rows_of_one_class_leave_the_threshold(spark):
    held = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0)], "toxic double, is_toxic double")
    assert toxicity._cutoff(held, "toxic", toxicity.Settings()) == 0.5


def test_sets_of_shingles_leave_the_disk_once_all_pairs_are_verified(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "a b c d e f")], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert near_copies.keep_one(docs).count() == 2
    fresh = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert "marks" in fresh and "sets" not in fresh

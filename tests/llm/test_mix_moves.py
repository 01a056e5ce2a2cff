"""Texts of the mix are not moved again by the join with the offsets of their buckets."""

from daybook.llm import mixing


def test_texts_move_once_before_the_sort_of_the_mix(spark):
    rows = [(i, ["a", "b", None, ""][i % 4], "word " * (i % 7 + 1)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        order = mixing.training_order(docs, mixing.Curriculum(bucket_rows=20))
        wide = [x for x in order._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert len([x for x in wide if "nameless" in x and "bucket" in x]) == 2
        found = order.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = {s: sum(r["mix_size"] if "mix_size" in r else r["size"] for r in found if r["source"] == s) for s in ("a", "b", None, "")}
    targets = {r["source"]: r["target"] for r in found}
    assert all(abs(sizes[s] - targets[s]) <= 7 for s in targets) and len(targets) == 4

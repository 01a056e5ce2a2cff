"""The toxicity chain scores texts in a session that has observed a frame."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from daybook.llm import toxicity


def test_a_category_scores_after_an_observation(spark):
    watch = Observation("rows")
    assert spark.range(3).observe(watch, F.count("*").alias("n")).count() == 3 and watch.get["n"] == 3
    rows = [(Vectors.dense([float(i % 2), float(i % 3 == 0)]), float(i % 2)) for i in range(40)]
    frame = spark.createDataFrame(rows, ["presence", "is_toxic"])
    model = toxicity._fit(frame, "is_toxic", [], toxicity.Settings())
    scored = toxicity._with_probability(frame, model, "toxic", []).select("is_toxic", "toxic").collect()
    assert min(r.toxic for r in scored if r.is_toxic) > max(r.toxic for r in scored if not r.is_toxic)

import math

from pyspark.sql import functions as F

from veritrace.functions import tensors
from veritrace.operators import metrics


def test_retention_fills_up(spark):
    schema = "step int, overall_macro_f1 double, least_macro_f1 double, least_recall double"
    left = lambda rows, **k: sorted(r.step for r in metrics.pruned(spark.createDataFrame([(s, f, f, f) for s, f in rows], schema), **k).collect())
    rows = [(1, 0.1), (50, 0.2), (100, 0.9)]
    assert left(rows) == [1, 50] and left(rows, least=2) == [1]
    assert left([(1, 0.9), (50, 0.2), (100, 0.3)], least=2) == [50]
    assert left([(7, 0.5)], least=2) == [] and left([], least=2) == []


def test_rollout_weights(spark):
    df = spark.createDataFrame([([-1.0, -2.0], [-1.5, -1.0], [0.5, 2.0])], "new array<double>, old array<double>, w array<double>")
    got = df.select(tensors.clipped_terms(F.col("new"), F.col("old"), F.lit(2.0), 0.2, 0.28, F.col("w")).alias("t")).first().t
    want = [-max(min(math.exp(a - b), 1.28), 0.8) * 2 * a * w for a, b, w in ((-1.0, -1.5, 0.5), (-2.0, -1.0, 2.0))]
    assert all(abs(x - y) < 1e-12 for x, y in zip(got, want))


def test_truncated_prompts(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("a", True), ("b", False)], "source string, prompt_truncated boolean")
    assert {r.source: r.truncated_prompts for r in df.groupBy("source").agg(metrics.truncated_prompts()).collect()} == {"a": 2, "b": 0}

"""Evaluation bookkeeping: pending and missing items, conflicts, provenance, resumption, scoring by a pluggable predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORED = "dataset_index long, prediction string, prompt_tokens int, generated_tokens int"


def pending(items: DataFrame, done: DataFrame, key: str | list[str] = "dataset_index") -> DataFrame:
    """Items without a prediction (left anti)."""
    keys = [key] if isinstance(key, str) else key
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def conflicts(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with rows that differ; rows that are repeated exactly aren't a conflict."""
    rest = F.xxhash64(*[c for c in predictions.columns if c not in keys])
    return predictions.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(rest).alias("n_versions")).filter("n_versions > 1")


def consolidated(predictions: DataFrame, columns: list[str] | None = None, whole: list[str] | None = None) -> DataFrame:
    """Repeated rows once.

    With `columns`, only these come out, and rows are told apart by them and two hashes of the whole row (of the columns `whole`, if
    the others follow from them): long texts that aren't wanted are hashed where they are read, not shuffled. Rows that differ in a
    column that isn't kept stay two rows.
    """
    if not columns:
        return predictions.dropDuplicates()
    whole = whole or predictions.columns
    return predictions.select(*columns, F.xxhash64(*whole).alias("_h1"), F.xxhash64(F.lit(7), *reversed(whole)).alias("_h2")).distinct().drop("_h1", "_h2")


def provenance_mismatch(predictions: DataFrame, items: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Predictions whose fields differ from their item's; null is equal to null. wrong names the first such field."""
    other = items.select(*keys, *[F.col(f).alias("_" + f) for f in fields])
    wrong = F.coalesce(*[F.when(~F.col(f).eqNullSafe(F.col("_" + f)), F.lit(f)) for f in fields])
    return predictions.join(other, keys).withColumn("wrong", wrong).filter("wrong is not null").drop(*["_" + f for f in fields])


def resume_differences(old: DataFrame, new: DataFrame, required: list[str] | None = None, optional: list[str] | None = None) -> DataFrame:
    """(name, old, new) of the settings that differ, of two tables (name, value); settings that one lacks count as null.

    With `required` or `optional`, only settings so named count, and an optional one only if the old table has it, so that a new
    setting doesn't spoil what was recorded before there was one.
    """
    a, b = old.select("name", F.col("value").alias("old"), F.lit(True).alias("_had")), new.select("name", F.col("value").alias("new"))
    both = a.join(b, "name", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    if required is not None or optional is not None:
        both = both.filter(F.col("name").isin(required or []) | (F.col("name").isin(optional or []) & F.col("_had")))
    return both.drop("_had")


def manifest_errors(rows: DataFrame, index_from: int | None = 0) -> DataFrame:
    """Adds error: the first thing wrong with the fields that say where a record comes from, null if nothing is.

    bad_source and bad_split (null or blank), bad_index (null, or less than index_from unless that is None), bad_sha256 (not 64
    hexadecimal digits).
    """
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    index = F.col("source_index")
    error = F.when(blank("source"), "bad_source").when(blank("source_split"), "bad_split").when(index.isNull() | (index < (index if index_from is None else F.lit(index_from))), "bad_index")
    return rows.withColumn("error", error.when(~F.coalesce(F.col("content_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "bad_sha256"))


def source_gaps(rows: DataFrame, expected: list[str], source: str = "source") -> DataFrame:
    """(source, problem, n): sources that aren't expected (unknown, with their rows) and expected ones without a row (missing)."""
    want = rows.sparkSession.createDataFrame([(s,) for s in expected], f"{source} string").withColumn("_want", F.lit(True))
    have = rows.groupBy(source).agg(F.count("*").alias("n"))
    both = have.withColumn("_have", F.lit(True)).join(F.broadcast(want), source, "full_outer")
    problem = F.when(F.col("_want").isNull(), "unknown").when(F.col("_have").isNull(), "missing")
    return both.select(source, problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).filter("problem is not null")


def checkpoint_of(steps: DataFrame, checkpoints: DataFrame, base: str, step: str = "step", strict: bool = False) -> DataFrame:
    """Adds the checkpoint path of each step; step 0 is the base model. A step without one has null, or fails the job if strict."""
    found = steps.join(checkpoints.select(F.col(step), F.col("path").alias("checkpoint")).dropDuplicates([step]), step, "left")
    path = F.when(F.col(step) == 0, F.lit(base)).otherwise(F.col("checkpoint"))
    if strict:
        path = F.coalesce(path, F.raise_error(F.concat(F.lit("no checkpoint of step "), F.col(step).cast("string"))).cast("string"))
    return found.withColumn("checkpoint", path)


def required_missing(settings: DataFrame, required: list[str], by: list[str]) -> DataFrame:
    """(by, name): required settings that a key lacks; settings has a column name. Keys without any setting aren't known."""
    want = settings.select(*by).distinct().withColumn("name", F.explode(F.array(*map(F.lit, required))))
    return want.join(settings.select(*by, "name").distinct(), [*by, "name"], "left_anti")


def vocabulary_errors(ids: DataFrame, size: int, by: list[str], col: str = "ids") -> DataFrame:
    """(by, least, most) of the keys with a token id that isn't in 0 ... size - 1. Empty and null lists have none."""
    ends = ids.groupBy(*by).agg(F.min(F.array_min(col)).alias("least"), F.max(F.array_max(col)).alias("most"))
    return ends.filter((F.col("least") < 0) | (F.col("most") >= size))


def score(items: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, int, int]]]], prompt: str = "prompt", batch: int = 64) -> DataFrame:
    """Runs a predictor over items in batches: (dataset_index, prediction, prompt_tokens, generated_tokens).

    load is called once in each worker and only if there is something to score; what it returns maps prompts to
    (text, prompt tokens, generated tokens).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                predict = predict or load()
                out = predict(part[prompt].tolist())
                yield pd.DataFrame({"dataset_index": part["dataset_index"], "prediction": [o[0] for o in out], "prompt_tokens": [o[1] for o in out], "generated_tokens": [o[2] for o in out]})

    return items.select("dataset_index", prompt).mapInPandas(run, SCORED)

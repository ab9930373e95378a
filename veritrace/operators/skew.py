"""Joins that hold when one key has a third of all rows, and semi joins that check a size before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.runtime import BROADCAST_ROWS


#: Rows of a hot key that one task takes.
ROWS_A_TASK = 1_000_000


def hot_keys(df: DataFrame, on: list[str], share: float = 0.001, least: int = 10_000) -> DataFrame:
    """Keys that hold more than `share` of df's rows and more than `least` rows, with their rows n: at most 1/share of them, whatever the size."""
    counts = df.groupBy(*on).agg(F.count("*").alias("n"))
    total = df.count()
    return counts.filter(F.col("n") > max(least, int(total * share))).select(*on, "n")


def skew_join(many: DataFrame, few: DataFrame, on: list[str], salts: int = 24, share: float = 0.001, least: int = 10_000) -> DataFrame:
    """Inner join in which the rows of a hot key of `many` are spread over tasks and those of `few` repeated for them.

    A hot key is spread over `salts` tasks, or over more where it has more than ROWS_A_TASK rows for each. Both sides should be
    tables already written (they are read twice). Null keys never match. The list of hot keys is bounded by 1/share rows and
    is the only thing broadcast.
    """
    spread_over = F.greatest(F.lit(salts), F.ceil(F.col("n") / ROWS_A_TASK).cast("int"))
    hot = F.broadcast(hot_keys(many, on, share, least).withColumn("_salts", spread_over).drop("n"))
    salted = (
        many.join(hot, on, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.col("_salts"))).otherwise(F.lit(0)).cast("int"))
        .drop("_salts")
    )
    spread = (
        few.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))))
        .drop("_salts")
    )
    return salted.join(spread, [*on, "_salt"]).drop("_salt")


def semi_checked(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_ROWS, how: str = "left_semi") -> DataFrame:
    """Left semi (or anti) join on one key column; the key set is broadcast only if it was counted to be small enough.

    keys should be a written table with one distinct column. Beyond the limit the same join runs by shuffle.
    """
    n = keys.limit(limit + 1).count()
    return df.join(F.broadcast(keys) if n <= limit else keys.hint("shuffle_hash"), on, how)

"""Verdict metrics: one core over (gold, predicted or null), and what selects checkpoints by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 9


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def counts() -> list[Column]:
    """The counters that everything else follows from; they add up over batches and partitions."""
    gold, pred = F.col("gold"), F.coalesce(F.col("pred"), F.lit("unparseable"))
    out = [F.count("*").alias("n"), F.count("pred").alias("parsed")]
    for g in ("safe", "unsafe"):
        out += [F.count_if((gold == g) & (pred == p)).alias(f"{g}_{p}") for p in ("safe", "unsafe", "unparseable")]
    return out


def rates(df: DataFrame) -> DataFrame:
    """Adds accuracy, parse rate, and precision, recall and F1 of each class and their means to the counters."""
    c = F.col
    df = df.withColumns({"safe": c("safe_safe") + c("safe_unsafe") + c("safe_unparseable"), "unsafe": c("unsafe_safe") + c("unsafe_unsafe") + c("unsafe_unparseable")})
    p = {"safe": ratio(c("safe_safe"), c("safe_safe") + c("unsafe_safe")), "unsafe": ratio(c("unsafe_unsafe"), c("unsafe_unsafe") + c("safe_unsafe"))}
    r = {x: ratio(c(f"{x}_{x}"), c(x)) for x in ("safe", "unsafe")}
    f = {x: _f1(p[x], r[x]) for x in ("safe", "unsafe")}
    mean = lambda m: (m["safe"] + m["unsafe"]) / 2
    cols = {"accuracy": ratio(c("safe_safe") + c("unsafe_unsafe"), c("n")), "parse_rate": ratio(c("parsed"), c("n"))}
    for x in ("safe", "unsafe"):
        cols |= {f"{x}_precision": p[x], f"{x}_recall": r[x], f"{x}_f1": f[x]}
    cols |= {"macro_precision": mean(p), "macro_recall": mean(r), "macro_f1": mean(f)}
    return df.withColumns({k: F.round(v, DIGITS) for k, v in cols.items()})


def metrics(rows: DataFrame, by: list[str] | None = None, source: str = "source") -> DataFrame:
    """Per key of `by` and source, and over all sources (is_overall): counters and rates in one pass.

    rows: gold (safe or unsafe), pred (the same or null; null is wrong, never safe), source and the columns of `by`.
    Whether a row is the total follows from the grouping, not from its name, so that no source can be mistaken for it.
    """
    by = by or []
    sets = [[*by, source], by]
    return rates(rows.groupingSets(sets, *by, source).agg((F.grouping(source) == 1).alias("is_overall"), *counts()))


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """A sorted list of gold__pred counts for each key, as 'gold_g__pred_p=n' texts."""
    cell = F.concat(F.lit("gold_"), F.col("gold"), F.lit("__pred_"), F.coalesce(F.col("pred"), F.lit("unparseable")))
    pre = rows.groupBy(*by, cell.alias("cell")).agg(F.count("*").alias("n"))
    return pre.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "cell", F.col("n").cast("string")))), ";").alias("confusion"))


def selection_keys(per_source: DataFrame, step: str = "step") -> DataFrame:
    """(step, overall_macro_f1, least_macro_f1, least_recall) from metrics(by=[step])."""
    return per_source.groupBy(step).agg(
        F.max(F.when(F.col("is_overall"), F.col("macro_f1"))).alias("overall_macro_f1"),
        F.min(F.when(~F.col("is_overall"), F.col("macro_f1"))).alias("least_macro_f1"),
        F.max(F.when(F.col("is_overall"), F.least("safe_recall", "unsafe_recall"))).alias("least_recall"),
    )


def _key(step: str) -> Column:
    return F.struct("overall_macro_f1", "least_macro_f1", "least_recall", (-F.col(step)).alias("m"))


def best_and_latest(keys: DataFrame, step: str = "step") -> DataFrame:
    """One row: the step of the greatest key (the earliest of equal ones) and the last step."""
    return keys.agg(F.max_by(step, _key(step)).alias("best_step"), F.max(step).alias("latest_step"))


def running_best(keys: DataFrame, step: str = "step") -> DataFrame:
    """At each step the best so far, the latest, and which steps are kept then. Steps are a handful a run."""
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    best = -F.max(_key(step)).over(w)["m"]
    return keys.select(step, best.alias("best_step"), F.max(step).over(w).alias("latest_step"))


def truncated_prompts(col: str = "prompt_truncated") -> Column:
    """Rows whose prompt was truncated; null counts as not. It adds up like the other counters."""
    return F.count_if(F.coalesce(F.col(col), F.lit(False))).alias("truncated_prompts")


def pruned(keys: DataFrame, step: str = "step", least: int = 0) -> DataFrame:
    """Steps that are neither the best nor the latest in the end, nor needed, the newest first, to keep `least` of them."""
    ends = keys.agg(F.max_by(step, _key(step)).alias("best_step"), F.max(step).alias("latest_step"), F.sort_array(F.collect_set(step), asc=False).alias("steps"))
    kept = F.array_distinct(F.array("best_step", "latest_step"))
    filled = F.concat(kept, F.slice(F.array_except("steps", kept), 1, F.greatest(F.lit(least) - F.size(kept), F.lit(0))))
    return keys.select(step).join(ends.select(F.explode(filled).alias(step)).distinct(), step, "left_anti")


def outcome_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shares of rewards and mean flags of logged rollouts: reward, parsed, correct."""
    share = lambda v: F.round(F.avg(F.when(F.col("reward") == v, 1.0).otherwise(0.0)), DIGITS)
    return rows.groupBy(*by).agg(
        F.round(F.avg(F.col("parsed").cast("double")), DIGITS).alias("parse_rate"), F.round(F.avg(F.col("correct").cast("double")), DIGITS).alias("correct_rate"),
        share(-1.25).alias("malformed"), share(-1.0).alias("wrong"), share(1.0).alias("right"), F.count("*").alias("n"),
    )

"""Array expressions over token sequences: masks, regions, rewards, advantages and loss values, one row a response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.operators.metrics import DIGITS, ratio

# Rewards of a strict response and the size of the label tail.
REWARD_RIGHT, REWARD_WRONG, REWARD_MALFORMED = 1.0, -1.0, -1.25
TAIL = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it (inside a lambda too)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strict_reward(valid: Column, label: Column, target: Column) -> Column:
    """Reward of a strictly parsed response; null if the target isn't a label."""
    r = F.when(~F.coalesce(valid, F.lit(False)), REWARD_MALFORMED).when(label == target, REWARD_RIGHT).otherwise(REWARD_WRONG)
    return F.when(target.isin("safe", "unsafe"), r)


def valid_length(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))


def terminal_reward(reward: Column, mask: Column) -> Column:
    """Zeros but for the reward at the last valid place (the first one if none is valid)."""
    at = F.greatest(valid_length(mask) - 1, F.lit(0))
    return let(at, lambda k: F.transform(mask, lambda m, i: F.when(i == k, reward).otherwise(0.0)))


def centred_advantage(df: DataFrame, batch: str, reward: str = "reward") -> DataFrame:
    """Adds the reward less the mean of its whole batch. The mean is aggregated before it is joined, so a large batch does no harm."""
    mean = df.groupBy(batch).agg(F.avg(reward).alias("_mean"))
    return df.join(mean, batch).withColumn("advantage", F.col(reward) - F.col("_mean")).drop("_mean")


def on_tokens(value: Column, mask: Column) -> Column:
    """The value at every valid place, 0 elsewhere."""
    return F.transform(mask, lambda m: F.when(m, value).otherwise(0.0))


def label_region(mask: Column, tail: int = TAIL) -> Column:
    """True on the last `tail` valid places; the valid ones come first (padding is on the right)."""
    start = F.greatest(valid_length(mask) - tail, F.lit(0))
    return let(start, lambda k: F.transform(mask, lambda m, i: m & (i >= k)))


def analysis_region(mask: Column, tail: int = TAIL) -> Column:
    start = F.greatest(valid_length(mask) - tail, F.lit(0))
    return let(start, lambda k: F.transform(mask, lambda m, i: m & (i < k)))


def importance_ratio(new: Column, old: Column) -> Column:
    """exp of the difference of log probabilities, which is kept within 20."""
    return F.transform(F.arrays_zip(new.alias("new"), old.alias("old")), lambda x: F.exp(F.greatest(F.least(x["new"] - x["old"], F.lit(20.0)), F.lit(-20.0))))


def clipped_terms(new: Column, old: Column, advantage: Column, low: float, high: float, weight: Column | None = None) -> Column:
    """Loss of each token: -clip(ratio) * advantage * log probability, times the token's rollout weight if there are weights."""
    terms = F.transform(
        F.arrays_zip(importance_ratio(new, old).alias("r"), new.alias("new")),
        lambda x: -F.greatest(F.least(x["r"], F.lit(1.0 + high)), F.lit(1.0 - low)) * advantage * x["new"],
    )
    return terms if weight is None else F.zip_with(terms, weight, lambda t, w: t * w)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values where the mask is set, 0 where it is nowhere."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"])
    return let(kept, lambda k: ratio(F.aggregate(k, F.lit(0.0), lambda a, x: a + x["v"]), F.size(k)))


def region_loss(df: DataFrame, batch: str, terms: str = "terms", mask: str = "mask", weight: float = 2.0, tail: int = TAIL, global_batch: int | None = None, workers: int = 1) -> DataFrame:
    """Per batch: mean over responses of the mean over analysis tokens, the same over label tokens, and their weighted sum.

    The mean is over the batch's own responses; with global_batch, sums are divided by that number and multiplied by the number of
    data-parallel workers instead, so that what workers average is the mean over the whole of it.
    """
    if global_batch is not None and global_batch < 1 or workers < 1 or weight < 0 or tail < 1:
        raise ValueError("global_batch, workers and tail must be 1 or more, the weight 0 or more")
    per = df.select(batch, masked_mean(F.col(terms), analysis_region(F.col(mask), tail)).alias("a"), masked_mean(F.col(terms), label_region(F.col(mask), tail)).alias("l"))
    mean = F.avg if global_batch is None else lambda c: F.sum(c) / F.lit(float(global_batch)) * F.lit(workers)
    out = per.groupBy(batch).agg(mean("a").alias("a"), mean("l").alias("l"), F.count("*").alias("n"))
    return out.select(batch, F.round("a", DIGITS).alias("analysis_loss"), F.round("l", DIGITS).alias("label_loss"), F.round(F.col("a") + weight * F.col("l"), DIGITS).alias("loss"), "n")


def clip_range(low: float | None, high: float | None, both: float | None = None) -> tuple[float, float]:
    """(low, high) of the ratio's clip; a missing side is `both`. ValueError unless 0 <= low < 1 and 0 <= high."""
    low, high = (both if x is None else x for x in (low, high))
    if low is None or high is None or not (0 <= low < 1 and high >= 0):
        raise ValueError(f"no clip range from {low} and {high}")
    return low, high


def responses_a_worker(prompts: int, rollouts: int, workers: int) -> int:
    """Responses of a mini-batch that each worker takes; ValueError if they can't be shared out evenly."""
    if min(prompts, rollouts, workers) < 1 or prompts * rollouts % workers:
        raise ValueError(f"{prompts} x {rollouts} responses for {workers} workers")
    return prompts * rollouts // workers


def given_or(given: Column, computed: Column) -> Column:
    """A score that came with the rows, else the computed one."""
    return F.coalesce(given, computed)


#: Advantage estimators and losses by name; a caller may register others.
ADVANTAGES: dict[str, Callable] = {}
LOSSES: dict[str, Callable] = {}


def register(registry: dict[str, Callable], name: str) -> Callable[[Callable], Callable]:
    """Registers a function under a name; ValueError if the name is taken by another one."""

    def add(f: Callable) -> Callable:
        if registry.get(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        registry[name] = f
        return f

    return add


def lookup(registry: dict[str, Callable], name: str) -> Callable:
    if name not in registry:
        raise ValueError(f"{name!r} isn't one of {', '.join(sorted(registry))}")
    return registry[name]


register(ADVANTAGES, "outcome_centred")(centred_advantage)
register(LOSSES, "clipped_regions")(region_loss)


def loss_diagnostics(df: DataFrame, batch: str, low: float, high: float, tail: int = TAIL) -> DataFrame:
    """Per batch over valid tokens: mean negative log ratio, share of clipped ratios, share of tokens and of responses with an advantage,
    and the mean absolute advantage over responses, over analysis tokens and over label tokens."""
    r = importance_ratio(F.col("new"), F.col("old"))
    kept = df.select(batch, "advantage", F.filter(F.arrays_zip(r.alias("r"), F.col("mask").alias("m")), lambda x: x["m"]).alias("k"))
    k, a = F.col("k"), F.abs("advantage")
    per = kept.select(
        batch, "advantage", F.size(k).alias("n"), F.aggregate(k, F.lit(0.0), lambda a, x: a - F.ln(x["r"])).alias("kl"),
        F.size(F.filter(k, lambda x: (x["r"] < 1.0 - low) | (x["r"] > 1.0 + high))).alias("c"),
    )
    label, active = F.least("n", F.lit(tail)), (F.col("advantage") != 0).cast("double")
    mean = lambda x, n: F.round(ratio(F.sum(x * n), F.sum(n)), DIGITS)
    return per.groupBy(batch).agg(
        F.round(ratio(F.sum("kl"), F.sum("n")), DIGITS).alias("kl"), F.round(ratio(F.sum("c"), F.sum("n")), DIGITS).alias("clip_share"),
        F.round(F.avg(active), DIGITS).alias("active_share"), mean(active, F.col("n")).alias("active_token_share"), F.round(F.avg(a), DIGITS).alias("mean_abs_advantage"),
        mean(a, F.col("n") - label).alias("analysis_abs_advantage"), mean(a, label).alias("label_abs_advantage"),
    )


def reward_record(strict: Column, target: Column, source: Column, sha256: Column) -> list[Column]:
    """What is logged of a scored response: nine columns. strict is its codec.strict_response; an unknown source is 'unknown'."""
    reward = strict_reward(strict["valid"], strict["label"], target)
    return [
        reward.alias("outcome_reward"), reward.alias("label_reward"), F.coalesce(strict["valid"] & (strict["label"] == target), F.lit(False)).cast("double").alias("label_correct"),
        F.coalesce(strict["valid"], F.lit(False)).cast("double").alias("parse_ok"), strict["label"].alias("pred"), target.alias("target_label"), F.coalesce(source, F.lit("unknown")).alias("source"),
        F.coalesce(sha256, F.lit("")).alias("content_sha256"), F.coalesce(F.length(strict["analysis"]), F.lit(0)).cast("double").alias("analysis_chars"),
    ]


def weighted_mean_loss(loss: Column, mask: Column, last: int, weight: float) -> Column:
    """Mean of the valid losses, the last `last` of them weighted; the divisor is at least 1."""
    kept = F.filter(F.arrays_zip(loss.alias("v"), mask.alias("m")), lambda x: x["m"])

    def weigh(k: Column) -> Column:
        first = F.size(k) - last
        total = F.aggregate(F.transform(k, lambda x, i: x["v"] * F.when(i >= first, weight).otherwise(1.0)), F.lit(0.0), lambda a, x: a + x)
        heavy = F.least(F.size(k), F.lit(last))
        return total / F.greatest(F.size(k) - heavy + heavy * F.lit(float(weight)), F.lit(1.0))

    return let(kept, weigh)


def distinct_ids(ids: Column) -> Column:
    """Non-negative ids in order of first sight."""
    return F.array_distinct(F.filter(ids, lambda x: x >= 0))


def without_padding(ids: Column, pad: int) -> Column:
    """Without the run of pad ids at the end; others stay."""
    at = F.array_position(F.transform(F.reverse(ids), lambda x: x != pad), True)
    return F.slice(ids, 1, (F.size(ids) - F.coalesce(F.nullif(at, F.lit(0)) - 1, F.size(ids).cast("long"))).cast("int"))


def prefix_ids(ids: Column, n: int) -> Column:
    """struct(ids, truncated, original) of the first n ids."""
    return F.struct(F.slice(ids, 1, n).alias("ids"), (F.size(ids) > n).alias("truncated"), F.size(ids).alias("original"))



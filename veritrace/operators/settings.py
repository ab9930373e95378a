"""Rules over settings: a table (key, name, value) in, a row for each rule that a key breaks out.

Settings are rows, not columns, so that one plan checks the settings of every run that was ever recorded. A rule is a boolean expression
over the settings it names; it is broken where it is false, and where a setting it needs is missing or not a number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The settings of a training run, and what must hold between them.
POSITIVE = (
    "samples_per_stratum", "gpus", "train_batch_size", "validation_batch_size", "ppo_mini_batch_size", "ppo_epochs", "total_epochs", "max_prompt_length", "max_response_length", "max_model_len",
    "max_num_batched_tokens", "max_num_seqs", "ppo_max_token_len_per_gpu", "rollout_n", "rollout_tp", "label_tail_tokens", "max_checkpoints",
)
LAUNCH = {f"{n}_positive": f"{n} >= 1" for n in POSITIVE} | {
    "model_len_holds_both": "max_model_len >= max_prompt_length + max_response_length",
    "batched_tokens_hold_model_len": "max_num_batched_tokens >= max_model_len",
    "update_tokens_hold_a_sequence": "ppo_max_token_len_per_gpu >= max_prompt_length + max_response_length",
    "response_holds_label_tail": "max_response_length >= label_tail_tokens",
    "gpus_by_rollout_tp": "gpus % nullif(rollout_tp, 0) = 0",
    "batch_by_mini_batch": "train_batch_size % nullif(ppo_mini_batch_size, 0) = 0",
    "mini_batch_responses_by_gpus": "(ppo_mini_batch_size * rollout_n) % nullif(gpus, 0) = 0",
    "responses_by_gpus": "(train_batch_size * rollout_n) % nullif(gpus, 0) = 0",
    "whole_epoch": "(samples_per_stratum * 10) % nullif(train_batch_size, 0) = 0",
    "top_p_range": "top_p > 0 and top_p <= 1",
    "memory_share_range": "rollout_gpu_memory_utilization > 0 and rollout_gpu_memory_utilization <= 1",
    "learning_rate_positive": "learning_rate > 0",
    "weight_decay_not_negative": "weight_decay >= 0",
    "temperature_not_negative": "temperature >= 0",
    "clip_low_range": "clip_ratio_low >= 0 and clip_ratio_low < 1",
    "clip_high_not_negative": "clip_ratio_high >= 0",
    "saved_when_validated": "save_freq = test_freq and save_freq >= 1",
    "two_checkpoints": "max_checkpoints = 2",
}
EVALUATION = {n: f"{n} >= 1" for n in ("batch_size", "cutoff_len", "max_new_tokens")} | {"context": "cutoff_len + max_new_tokens <= max_position"}
#: Settings that must have one value.
TUNING = {"finetuning_type": "full", "eval_strategy": "epoch", "eval_on_start": "true", "save_strategy": "epoch", "load_best_model_at_end": "true", "save_total_limit": "2", "predict_with_generate": "true", "greater_is_better": "true"}
RETENTION = {"native_retention": "off", "async_save": "false"}

_WORD = re.compile(r"\b[a-z][a-z_]*\b")
_PLAIN = {"and", "or", "not", "is", "null", "nullif"}


def used(rule: str) -> list[str]:
    """The settings that a rule names."""
    return sorted(set(_WORD.findall(rule)) - _PLAIN)


def violations(settings: DataFrame, rules: dict[str, str], by: list[str]) -> DataFrame:
    """(by, rule, seen): each rule a key breaks, and the settings it names as 'name=value' texts.

    settings: the columns of by, name, value (text). A name that a key has several times counts with its least value. Keys are
    grouped once; a key has as many settings as there are names, so a group is small.
    """
    names = sorted({n for r in rules.values() for n in used(r)})
    kept = settings.filter(F.col("name").isin(names)).groupBy(*by, "name").agg(F.min("value").alias("value"))
    have = settings.select(*by).distinct().join(kept.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m")), by, "left")
    number = {n: f"try_cast(m['{n}'] as double)" for n in names}
    checks = []
    for rule, text in rules.items():
        holds = _WORD.sub(lambda w: number.get(w[0], w[0]), text)
        seen = ", ".join(f"concat('{n}=', coalesce(m['{n}'], '-'))" for n in used(text))
        checks.append(F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.expr(f"concat_ws(' ', {seen})").alias("seen"))))
    broken = have.select(*by, F.explode(F.array_compact(F.array(*checks))).alias("b"))
    return broken.select(*by, "b.rule", "b.seen")


def fixed_violations(settings: DataFrame, wanted: dict[str, str], by: list[str]) -> DataFrame:
    """(by, name, value, wanted) of the settings that haven't the one value they must have; a missing one has a null value."""
    want = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("wanted")) for n, v in sorted(wanted.items())])).alias("w")
    keys = settings.select(*by).distinct().select(*by, want).select(*by, "w.name", "w.wanted")
    have = settings.groupBy(*by, "name").agg(F.min(F.lower("value")).alias("value"))
    return keys.join(have, [*by, "name"], "left").filter(~F.coalesce(F.col("value") == F.col("wanted"), F.lit(False)))


def command_problems(overrides: DataFrame, by: list[str], required: list[str], forbidden: list[str], protected: list[str], equal: list[tuple[str, str]]) -> DataFrame:
    """(by, problem, name) of command overrides (by, name, value): forbidden prefixes, JSONL inputs, lacking or protected names, pairs that differ."""
    row = F.when(F.col("name").rlike("^(?:" + "|".join(map(re.escape, forbidden)) + ")"), "forbidden").when(F.col("name").endswith("_files") & F.col("value").endswith(".jsonl"), "jsonl_input")
    row = row.when(F.ltrim("name", F.lit("+")).isin(protected) & F.col("extra"), "protected")
    each = overrides.withColumn("problem", row).filter("problem is not null").select(*by, "problem", "name")
    values = overrides.groupBy(*by).agg(F.collect_set("name").alias("names"), *[F.collect_set(F.when(F.col("name") == n, F.col("value"))).alias(f"v_{i}_{j}") for i, pair in enumerate(equal) for j, n in enumerate(pair)])
    lacking = values.select(*by, F.lit("missing").alias("problem"), F.explode(F.array_except(F.array(*map(F.lit, required)), "names")).alias("name"))
    out = each.unionByName(lacking)
    for i, (a, _) in enumerate(equal):
        same = (F.size(f"v_{i}_0") == 1) & F.col(f"v_{i}_0").eqNullSafe(F.col(f"v_{i}_1"))
        out = out.unionByName(values.filter(~same).select(*by, F.lit("differs").alias("problem"), F.lit(a).alias("name")))
    return out

"""Registered queries of evaluation and training bookkeeping: settings, manifests, checkpoints, logged rewards, chat records.

The tables hold no settings of training runs, so these are made from eval_run by arithmetic that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.functions import codec, tensors
from veritrace.operators import curate, evaluate, settings
from veritrace.plans.queries import _ADV_SQL, _ITEMS, _TOK, HIGH, LOW, _batched, _items, _strict, _strip, query
from veritrace.runtime import table

# ---- settings

#: Value of each setting of a run; every tenth run lacks some.
_VALUES = {n: "run_id % 4 + 1" for n in settings.POSITIVE} | {
    "max_prompt_length": "max_prompt_length", "max_response_length": "max_new_tokens", "max_model_len": "max_prompt_length + max_new_tokens - (run_id % 3) * (run_id % 5)", "max_num_batched_tokens": "max_prompt_length + max_new_tokens + 7 - run_id % 20",
    "ppo_max_token_len_per_gpu": "16000 + run_id * 100", "gpus": "case when run_id % 10 = 0 then null else run_id % 9 end", "train_batch_size": "32 + run_id % 3", "ppo_mini_batch_size": "8", "label_tail_tokens": "12", "max_checkpoints": "run_id % 3",
    "save_freq": "50", "test_freq": "50 - run_id % 2", "clip_ratio_low": "(run_id % 7) / 5.0", "clip_ratio_high": "0.28", "top_p": "(run_id % 6) / 4.0", "rollout_gpu_memory_utilization": "0.6", "learning_rate": "(run_id % 8) * 0.000001", "weight_decay": "-(run_id % 2)", "temperature": "1.0",
    "batch_size": "run_id % 3", "cutoff_len": "max_prompt_length", "max_new_tokens": "max_new_tokens", "max_position": "max_prompt_length + 256 + run_id",
    "finetuning_type": "case when run_id % 5 = 0 then 'lora' else 'full' end", "eval_strategy": "case when run_id % 7 = 0 then null else 'epoch' end", "eval_on_start": "'True'", "save_strategy": "'epoch'", "load_best_model_at_end": "'true'",
    "save_total_limit": "run_id % 4", "predict_with_generate": "'true'", "greater_is_better": "'false'", "native_retention": "'off'", "async_save": "case when run_id % 2 = 0 then 'true' else 'false' end",
}


def _settings(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(f"cast({v} as string)").alias("value")) for n, v in _VALUES.items()])).alias("x")
    return table(spark, d, "eval_run").select("run_id", pairs).select("run_id", "x.*").filter("value is not null")


def _wide(names) -> str:
    return "(select run_id, " + ", ".join(f"{_VALUES[n]} as {n}" for n in names) + " from eval_run)"


def _rules_sql(rules: dict[str, str]) -> str:
    names = sorted({n for r in rules.values() for n in settings.used(r)})
    return f"with w as {_wide(names)} " + " union all ".join(f"select run_id, '{rule}' as rule from w where not coalesce({text}, false)" for rule, text in rules.items())


@query(_rules_sql(settings.LAUNCH))
def launch_violations(spark: SparkSession, d: str) -> DataFrame:
    return settings.violations(_settings(spark, d), settings.LAUNCH, ["run_id"]).select("run_id", "rule")


@query(_rules_sql(settings.EVALUATION))
def evaluation_violations(spark: SparkSession, d: str) -> DataFrame:
    return settings.violations(_settings(spark, d), settings.EVALUATION, ["run_id"]).select("run_id", "rule")


_FIXED = settings.TUNING | settings.RETENTION


@query(f"with w as {_wide(_FIXED)} " + " union all ".join(f"select run_id, '{n}' as name, lower({n}::varchar) as value, '{v}' as wanted from w where lower({n}::varchar) is distinct from '{v}'" for n, v in _FIXED.items()))
def fixed_violations(spark: SparkSession, d: str) -> DataFrame:
    return settings.fixed_violations(_settings(spark, d), _FIXED, ["run_id"]).select("run_id", "name", "value", "wanted")


#: Overrides of a command, by arithmetic; null: the run's command lacks it.
_OVERRIDES = {
    "algorithm.estimator": "'outcome'", "policy.loss_mode": "case when run_id % 4 = 0 then null else 'clipped' end", "model.path": "'/m/' || cast(run_id as {s})", "model.tokenizer_path": "'/m/' || cast(run_id - run_id % 3 % 2 as {s})",
    "data.train_files": "case when run_id % 6 = 0 then 'a.jsonl' else 'a.json' end", "reward.remote": "case when run_id % 5 = 0 then 'x' end", "+trainer.save_freq": "'50'",
}
_NEEDED = ["algorithm.estimator", "policy.loss_mode"]


@query(
    "with o as (" + " union all ".join(f"select run_id, '{n}' as name, {v.format(s='varchar')} as value from eval_run" for n, v in _OVERRIDES.items()) + "), h as (select * from o where value is not null) "
    "select run_id, 'forbidden' as problem, name from h where starts_with(name, 'reward.') union all select run_id, 'jsonl_input', name from h where name = 'data.train_files' and ends_with(value, '.jsonl') "
    "union all select run_id, 'protected', name from h where name = '+trainer.save_freq' and run_id % 2 = 1 union all "
    + " union all ".join(f"select run_id, 'missing', '{n}' from eval_run where run_id not in (select run_id from h where name = '{n}')" for n in _NEEDED)
    + " union all select a.run_id, 'differs', 'model.path' from h a join h b on a.run_id = b.run_id where a.name = 'model.path' and b.name = 'model.tokenizer_path' and a.value <> b.value"
)
def command_problems(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(v.format(s="string")).alias("value")) for n, v in _OVERRIDES.items()])).alias("x")
    rows = table(spark, d, "eval_run").select("run_id", pairs).select("run_id", "x.*").filter("value is not null").withColumn("extra", F.col("run_id") % 2 == 1)
    return settings.command_problems(rows, ["run_id"], _NEEDED, ["reward."], ["trainer.save_freq"], [("model.path", "model.tokenizer_path")])


@query("select run_id, name from eval_run, (select unnest(['gpus', 'eval_strategy', 'top_p']) as name) n where (name = 'gpus' and run_id % 10 = 0) or (name = 'eval_strategy' and run_id % 7 = 0)")
def required_missing(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.required_missing(_settings(spark, d), ["gpus", "eval_strategy", "top_p"], ["run_id"])


def _of_run(spark: SparkSession, d: str, pick) -> DataFrame:
    s = _settings(spark, d)
    return s.join(F.broadcast(s.agg(pick("run_id").alias("run_id"))), "run_id", "left_semi").select("name", "value")


_REQUIRED, _OPTIONAL = ["max_prompt_length", "gpus", "top_p", "save_freq", "async_save"], ["finetuning_type", "eval_strategy", "batch_size"]
_LONG = "(" + " union all ".join(f"select run_id, '{n}' as name, ({_VALUES[n]})::varchar as value from eval_run" for n in (*_REQUIRED, *_OPTIONAL)) + ")"
_COMPARED = f"with s as (select * from {_LONG} where value is not null), a as (select name, value as old from s where run_id = (select min(run_id) from eval_run)), b as (select name, value as new from s where run_id = (select max(run_id) from eval_run)) "
_names = lambda x: ", ".join(f"'{n}'" for n in x)


@query(_COMPARED + f"select name, try_cast(old as double) as old_number, try_cast(new as double) as new_number from a full join b using (name) where old is distinct from new and (name in ({_names(_REQUIRED)}) or (name in ({_names(_OPTIONAL)}) and old is not null))")
def resume_keys(spark: SparkSession, d: str) -> DataFrame:
    """Of the first and last run: required settings that differ or that one lacks, optional ones only if the first has them."""
    x = evaluate.resume_differences(_of_run(spark, d, F.min), _of_run(spark, d, F.max), _REQUIRED, _OPTIONAL)
    return x.select("name", F.expr("try_cast(old as double)").alias("old_number"), F.expr("try_cast(new as double)").alias("new_number"))


# ---- manifests, sources, checkpoints


@query(f"select item_id, case when source is null or trim(source) = '' then 'bad_source' when source_split is null or trim(source_split) = '' then 'bad_split' when source_index is null or source_index < 5 then 'bad_index' when not coalesce(regexp_full_match(sha, '[0-9a-f]{{64}}'), false) then 'bad_sha256' end as error from {_ITEMS}")
def manifest_errors(spark: SparkSession, d: str) -> DataFrame:
    """Places are counted from 5, so that there is something to find."""
    return evaluate.manifest_errors(_items(spark, d).withColumnRenamed("sha", "content_sha256"), 5).select("item_id", "error")


@query(f"with h as (select source, count(*) as n from {_ITEMS} group by 1), w as (select unnest(['quartzline', 'nowhere']) as source) select h.source, 'unknown' as problem, n from h where source is null or source not in (select source from w) union all select source, 'missing', 0 from w where source not in (select source from h where source is not null)")
def source_gaps(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.source_gaps(_items(spark, d), ["quartzline", "nowhere"])


@query("select run_id, checkpoint_step, case when checkpoint_step - 1 = 0 then 'base' else (select max(c.checkpoint) from eval_run c where c.checkpoint_step = e.checkpoint_step - 1) end as checkpoint from eval_run e")
def step_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint of the step before each validation; step 0 is the base model."""
    runs = table(spark, d, "eval_run")
    have = runs.groupBy(F.col("checkpoint_step").alias("step")).agg(F.max("checkpoint").alias("path"))
    return evaluate.checkpoint_of(runs.select("run_id", "checkpoint_step", (F.col("checkpoint_step") - 1).alias("step")), have, "base").select("run_id", "checkpoint_step", "checkpoint")


# ---- rewards and losses

_LOGGED = (
    f"(select *, {_strict('raw_output', False)} as error from (select distinct * from audit_result) where label in ('safe', 'unsafe'))"
)
_CANON_LABEL, _CANON_TEXT = f"regexp_extract(raw_output, '{codec.CANON}', 2)", _strip(f"regexp_extract(raw_output, '{codec.CANON}', 1)")
_REWARD = f"(case when error is not null then -1.25 when {_CANON_LABEL} = label then 1.0 else -1.0 end)::double"


@query(
    f"select audit_id, {_REWARD} as outcome_reward, {_REWARD} as label_reward, (error is null and {_CANON_LABEL} = label)::int::double as label_correct, (error is null)::int::double as parse_ok, case when error is null then {_CANON_LABEL} end as pred, label as target_label, "
    f"coalesce(source, 'unknown') as source, coalesce(sha, '') as content_sha256, case when error is null then length({_CANON_TEXT}) else 0 end::double as analysis_chars from {_LOGGED} a left join (select item_id as i, sha from {_ITEMS}) s on a.item_id = s.i"
)
def reward_record(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "audit_result").filter("label in ('safe', 'unsafe')")
    a = t.withColumn("s", codec.strict_response(F.col("raw_output"))).join(_items(spark, d).select("item_id", "sha"), "item_id", "left")
    logged = a.select(*[c for c in t.columns if c != "source"], F.col("source").alias("_source"), *tensors.reward_record(F.col("s"), F.col("label"), F.col("source"), F.col("sha")))
    names = ["outcome_reward", "label_reward", "label_correct", "parse_ok", "pred", "target_label", "source", "content_sha256", "analysis_chars"]
    return evaluate.consolidated(logged, ["audit_id", *names], [c for c in t.columns if c != "source"] + ["_source"])


@query(f"select audit_id, coalesce(case when audit_id % 3 = 0 then (audit_id % 2)::double end, {_REWARD}) as score from {_LOGGED}")
def score_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """A score that came with the rows (a third of them has one) is kept."""
    a = table(spark, d, "audit_result").filter("label in ('safe', 'unsafe')").withColumn("s", codec.strict_response(F.col("raw_output")))
    given = F.when(F.col("audit_id") % 3 == 0, (F.col("audit_id") % 2).cast("double"))
    whole = [c for c in a.columns if c != "s"]
    a = a.withColumn("score", tensors.given_or(given, tensors.strict_reward(F.col("s.valid"), F.col("s.label"), F.col("label"))))
    return evaluate.consolidated(a, ["audit_id", "score"], whole)


_PER = f"(select a.audit_id, a.source, coalesce(avg(term) filter (where i < v2), 0) as ma, coalesce(avg(term) filter (where i >= v2), 0) as ml from (select *, greatest(v - 12, 0) as v2 from {_ADV_SQL}) a left join (select audit_id, i, term from {_TOK}) t using (audit_id) group by 1, 2)"


@query(f"select source, round(sum(ma) / 256.0 * 8, 6) as analysis_loss, round(sum(ml) / 256.0 * 8, 6) as label_loss, round((sum(ma) + 2 * sum(ml)) / 256.0 * 8, 6) as loss, count(*) as n from {_PER} group by source")
def region_loss_global(spark: SparkSession, d: str) -> DataFrame:
    """As region_loss, with the responses of a mini-batch of all workers (32 prompts with 8 rollouts, 8 workers) for divisor."""
    low, high = tensors.clip_range(LOW, None, HIGH)
    b = _batched(spark, d).withColumn("terms", tensors.clipped_terms(F.col("new"), F.col("old"), F.col("advantage"), low, high))
    loss = tensors.lookup(tensors.LOSSES, "clipped_regions")(b, "source", global_batch=8 * tensors.responses_a_worker(32, 8, 8), workers=8)
    return loss.select("source", *[F.round(c, 6).alias(c) for c in ("analysis_loss", "label_loss", "loss")], "n")


# ---- texts and chat records


@query("select run_id, dataset_index, case when lower(trim(x)) in ('unsafe', '1') then 'unsafe' when lower(trim(x)) in ('safe', '0') then 'safe' end as label, case when correct then 'unsafe' when not correct then 'safe' end as of_boolean from (select *, case run_id % 3 when 0 then predicted_label when 1 then ' 1 ' else 'true' end as x from prediction)")
def reward_label(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("run_id") % 3 == 0, F.col("predicted_label")).when(F.col("run_id") % 3 == 1, " 1 ").otherwise("true")
    return table(spark, d, "prediction").select("run_id", "dataset_index", codec.reward_label(x).alias("label"), codec.reward_label(F.col("correct")).alias("of_boolean"))


@query(f"select audit_id, '<analysis>' || chr(10) || nullif({_strip('analysis')}, '') || chr(10) || '</analysis>' || chr(10) || '<label>' || case lower({_strip('label')}) when 'unsafe' then 'unsafe' when 'controversial' then 'unsafe' when '1' then 'unsafe' when 'safe' then 'safe' when '0' then 'safe' end || '</label>' as response from audit_result")
def canonical_response(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "audit_result").select("audit_id", codec.canonical_response(F.col("analysis"), F.col("label")).alias("response"))


@query("select rl_id, sha256(list_reduce(list_prepend('', list_transform(messages, lambda m: '<|' || m.role || '|>' || chr(10) || coalesce(m.content, '') || chr(10))), lambda a, b: a || b) || '<|assistant|>' || chr(10)) as text_sha256 from rl_item where messages is not null and len(messages) > 0")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rl_item").filter("size(messages) > 0").select("rl_id", F.sha2(codec.rendered(F.col("messages")), 256).alias("text_sha256"))


_A, _B = "list_transform(range(run_id % 4), lambda i: 't' || (i % 3)::varchar)", "list_transform(range(run_id % 7), lambda i: 't' || (i * 2 % 9)::varchar)"


@query(f"select run_id, array_to_string(list_concat({_A}, list_filter({_B}, lambda x: not list_contains({_A}, x))), ',') as tokens from eval_run")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    of = lambda n, k, m: F.when(F.col("run_id") % n > 0, F.transform(F.sequence(F.lit(0), (F.col("run_id") % n - 1).cast("int")), lambda i: F.concat(F.lit("t"), (i * k % m).cast("string"))))
    return table(spark, d, "eval_run").select("run_id", F.array_join(curate.ordered_union(of(4, 1, 3), of(7, 2, 9)), ",").alias("tokens"))


_OPEN, _CLOSE = codec.OPEN, codec.CLOSE
_U = "messages[len(messages)].content"
_REST = f"substr({_U}, strpos({_U}, '{_OPEN}') + {len(_OPEN)})"
_BODY = f"case when strpos({_U}, '{_OPEN}') = 0 then {_U} when strpos({_REST}, '{_CLOSE}') > 0 then left({_REST}, length({_REST}) - strpos(reverse({_REST}), reverse('{_CLOSE}')) - {len(_CLOSE) - 1}) else {_REST} end"


@query(
    f"select rl_id, source as data_source, 'trajectory_safety_classification' as ability, 'strict_outcome_rule' as style, len(messages)::int as prompt_messages, label, case label when 'unsafe' then 1 else 0 end as label_int, reason, content_sha256, (row_number() over (order by sft_line, rl_id) - 1)::bigint as prepared_index, 'train_unique' as split, "
    f"source_index, sft_line, 0 as sampling_draw, false as sampling_repeat, case when coalesce({_strip(_BODY)}, '') = '' then 'empty_trajectory' end as error from rl_item where label in ('safe', 'unsafe') and messages is not null and len(messages) > 0"
)
def rl_record_full(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rl_item").filter("label in ('safe', 'unsafe') and size(messages) > 0").withColumn("_all", F.lit(0))
    rows = curate.ranked(rows, [F.col("sft_line"), F.col("rl_id")], "prepared_index", ["_all"]).withColumn("prepared_index", F.col("prepared_index").cast("long") - 1)
    r = curate.rl_records(rows, "train_unique")
    truth, extra = "reward_model.ground_truth.", "extra_info."
    return r.select(
        "rl_id", "data_source", "ability", F.col("reward_model.style").alias("style"), F.size("prompt").alias("prompt_messages"), truth + "label", truth + "label_int", truth + "reason", truth + "content_sha256", F.col(extra + "index").alias("prepared_index"),
        *[extra + c for c in ("split", "source_index", "sft_line", "sampling_draw", "sampling_repeat")], "error",
    )


@query(
    f"with s as (select sft_line, rl_id, source, label, content_sha256 as sha, messages from rl_item), v as (select sha from {_ITEMS} where source_split = 'validation' and sha is not null) "
    "select (select count(*) from (select content_sha256 from rl_item where content_sha256 is not null group by 1 having count(*) > 1)) as repeated, (select count(distinct sha) from s where lower(sha) in (select sha from v)) as leaked, count(distinct sha256(messages[1].content)) as system_prompts from s"
)
def rl_preconditions(spark: SparkSession, d: str) -> DataFrame:
    held = _items(spark, d).filter("source_split = 'validation'").select("sha")
    return curate.rl_preconditions(table(spark, d, "rl_item"), held.select(F.col("sha").alias("content_sha256")))


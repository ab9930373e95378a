"""Rules, guards and records that no query covers whole."""

import json

import pytest
from pyspark.sql import functions as F

from veritrace.functions import codec, tensors
from veritrace.operators import curate, evaluate, settings

RUN = {
    "samples_per_stratum": 512, "gpus": 8, "train_batch_size": 32, "validation_batch_size": 32, "ppo_mini_batch_size": 32, "ppo_epochs": 1, "total_epochs": 1, "max_prompt_length": 16000, "max_response_length": 384, "max_model_len": 16384,
    "max_num_batched_tokens": 16384, "max_num_seqs": 64, "ppo_max_token_len_per_gpu": 16384, "rollout_n": 8, "rollout_tp": 1, "label_tail_tokens": 12, "max_checkpoints": 2, "top_p": 1.0, "rollout_gpu_memory_utilization": 0.5,
    "learning_rate": 1e-6, "weight_decay": 0, "temperature": 1, "clip_ratio_low": 0.2, "clip_ratio_high": 0.28, "save_freq": 50, "test_freq": 50,
}


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, set()), ({"gpus": 0}, {"gpus_positive", "mini_batch_responses_by_gpus", "responses_by_gpus"}), ({"max_model_len": 16383}, {"model_len_holds_both"}), ({"rollout_tp": 3}, {"gpus_by_rollout_tp"}), ({"top_p": 0}, {"top_p_range"}),
        ({"clip_ratio_low": 1.0}, {"clip_low_range"}), ({"save_freq": 25}, {"saved_when_validated"}), ({"max_checkpoints": 3}, {"two_checkpoints"}), ({"samples_per_stratum": 33}, {"whole_epoch"}), ({"temperature": None}, {"temperature_not_negative"}), ({"weight_decay": "x"}, {"weight_decay_not_negative"}),
    ],
)
def test_launch_rules(spark, change, broken):
    rows = [(1, n, str(v)) for n, v in (RUN | change).items() if v is not None] + [(1, "other", "?")]
    out = settings.violations(spark.createDataFrame(rows, "run int, name string, value string"), settings.LAUNCH, ["run"]).collect()
    assert {r.rule for r in out} == broken and all(r.run == 1 for r in out)


def test_rules_on_nothing(spark):
    empty = spark.createDataFrame([], "run int, name string, value string")
    assert settings.violations(empty, settings.LAUNCH, ["run"]).count() == settings.fixed_violations(empty, settings.TUNING, ["run"]).count() == 0
    other = spark.createDataFrame([(1, "eval_on_start", "TRUE"), (1, "save_total_limit", "3")], empty.schema)
    assert {(r.name, r.value) for r in settings.fixed_violations(other, {"eval_on_start": "true", "save_total_limit": "2", "save_strategy": "epoch"}, ["run"]).collect()} == {("save_total_limit", "3"), ("save_strategy", None)}


def test_guards_and_registries(spark):
    assert tensors.clip_range(None, 0.3, 0.2) == (0.2, 0.3) and tensors.responses_a_worker(32, 8, 8) == 32
    for wrong in (lambda: tensors.clip_range(None, 0.3), lambda: tensors.clip_range(1.0, 0.3), lambda: tensors.responses_a_worker(3, 3, 2), lambda: tensors.lookup(tensors.LOSSES, "none"), lambda: tensors.register(tensors.ADVANTAGES, "outcome_centred")(print), lambda: tensors.region_loss(None, "b", global_batch=0)):
        with pytest.raises(ValueError):
            wrong()
    assert tensors.lookup(tensors.ADVANTAGES, "outcome_centred") is tensors.centred_advantage
    df = spark.createDataFrame([("b", [1.0] * 20, [True] * 20), ("b", [3.0] * 4, [True] * 4)], "b string, terms array<double>, mask array<boolean>")
    r = tensors.region_loss(df, "b", global_batch=8, workers=2).first()
    assert (r.analysis_loss, r.label_loss, r.loss) == (0.25, 1.0, 2.25)


def test_sql_functions(spark):
    codec.register_functions(spark)
    answers = ["<analysis>a</analysis>\n<label>safe</label>", "<analysis> </analysis><label>safe</label>", "<analysis><label>x</analysis><label>safe</label>", "safe", None]
    df = spark.createDataFrame([(a, t) for a in answers for t in ("safe", "unsafe", None)], "a string, t string")
    s = codec.strict_response(F.col("a"))
    got = df.select(F.expr("strict_reward(a, t)").alias("x"), tensors.strict_reward(s["valid"], s["label"], F.col("t")).alias("y"), F.expr("strict_label(a)").alias("u"), s["label"].alias("v")).collect()
    assert all(r.x == r.y and r.u == r.v for r in got)


def test_checkpoint_of(spark):
    steps = spark.createDataFrame([(0,), (50,), (70,)], "step int")
    have = spark.createDataFrame([(50, "c50"), (50, "c50")], "step int, path string")
    assert {r.step: r.checkpoint for r in evaluate.checkpoint_of(steps, have, "base").collect()} == {0: "base", 50: "c50", 70: None}
    with pytest.raises(Exception, match="no checkpoint of step 70"):
        evaluate.checkpoint_of(steps, have, "base", strict=True).collect()


def test_native_json(spark):
    for text in ('{"b": 1, "a": [true, null, "é"]}', "plain", '"x"', "[]"):
        want = json.dumps(json.loads(text) if text != "plain" else text, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        got = spark.createDataFrame([(text,)], "x string").select(codec.native_json(F.col("x")).alias("j")).first().j
        assert got == (want if text != "plain" else '["plain"]')


def test_rl_records(spark):
    rows = [(1, [("system", "s"), ("user", f"x\n{codec.OPEN}\nhi\n{codec.CLOSE}")], "web", "safe", "r", "h", 3, 7, 0), (2, [("user", f"{codec.OPEN}{codec.CLOSE}")], "web", "unsafe", None, None, 4, 8, 1), (3, None, None, None, None, None, None, None, 2)]
    df = spark.createDataFrame(rows, "rl_id int, messages array<struct<role:string,content:string>>, source string, label string, reason string, content_sha256 string, source_index int, sft_line int, prepared_index int")
    out = {r.rl_id: r for r in curate.rl_records(df, "validation").collect()}
    assert [out[i].error for i in (1, 2, 3)] == [None, "empty_trajectory", "empty_trajectory"]
    assert out[1].reward_model.ground_truth.label_int == 0 and out[1].extra_info.split == "validation" and out[1].extra_info["index"] == 0 and not out[1].extra_info.sampling_repeat

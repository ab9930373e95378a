import json
import os

import pytest
from pyspark.sql import functions as F

from veritrace import cli
from veritrace.sources import records, sinks
from veritrace.streaming import incremental


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


GOOD = {"content": [{"role": "user", "content": "hi"}], "label": 0, "reason": " a  b "}


def test_jsonl(spark, tmp_path):
    p = lines(tmp_path / "a.jsonl", [GOOD, "", "   ", "{broken", {**GOOD, "content": "text", "source": " own "}])
    got = records.records(spark, p).orderBy("line").collect()
    assert [(r.line, r.ordinal, r.value is None) for r in got] == [(1, 0, False), (4, 1, True), (5, 2, False)]
    good, bad = records.labelled(records.records(spark, p), "file", "train")
    assert [(r.source, r.source_index, r.content_kind, r.reason) for r in good.orderBy("line").collect()] == [("file", 0, "ARRAY", "a b"), ("own", 2, "STRING", "a b")]
    assert [(r.line, r.error) for r in bad.collect()] == [(4, "not_json")]
    records.register(spark)
    assert spark.read.format("labelled_jsonl").load(p).count() == 3


def test_jsonl_in_ranges(spark, tmp_path):
    rows = [json.dumps({"i": i, "x": "y" * (i % 40)}) if i % 5 else " " * (i % 3) for i in range(3000)]
    for name in ("a", "b"):
        lines(tmp_path / f"{name}.jsonl", rows)
    (tmp_path / "c.jsonl").write_text("\r\n1\r\n\r\n{\"a\": 2}", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = records.jsonl(spark, str(tmp_path / "*.jsonl")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [(k + 1, r) for k, r in enumerate(rows) if r.strip()]
    for name in ("a", "b"):
        mine = sorted((r.line, r.ordinal, r.raw) for r in got if r.file.endswith(f"/{name}.jsonl"))
        assert mine == [(line, n, r) for n, (line, r) in enumerate(kept)]
    assert sorted((r.line, r.ordinal, r.raw) for r in got if r.file.endswith("c.jsonl")) == [(2, 0, "1"), (4, 1, '{"a": 2}')]


def test_shards_steps_checkpoints_configs(spark, tmp_path):
    lines(tmp_path / "p.rank0.jsonl", [{"dataset_index": 0}, {"dataset_index": 1}])
    (tmp_path / "p.rank1.jsonl").write_text('{"dataset_index": 2}\n', encoding="utf-8")
    glob, schema = str(tmp_path / "p.rank*.jsonl"), "dataset_index long"
    assert sorted((r.dataset_index, r.file) for r in records.resumed(spark, glob, schema).collect()) == [(0, "p.rank0.jsonl"), (1, "p.rank0.jsonl"), (2, "p.rank1.jsonl")]
    (tmp_path / "p.rank1.jsonl").write_text('{"dataset_index": 2}\n{"datas', encoding="utf-8")
    with pytest.raises(ValueError, match="p.rank1.jsonl.*trimmed"):
        records.resumed(spark, glob, schema)
    (tmp_path / "p.rank1.jsonl").write_text('{"datas\n{"dataset_index": 2}\n', encoding="utf-8")
    with pytest.raises(ValueError, match="before its last"):
        records.resumed(spark, glob, schema)
    dump = tmp_path / "dump"
    dump.mkdir()
    with pytest.raises(ValueError, match="named by its step"):
        records.step_files(spark, str(dump), "pred string")
    lines(dump / "7.jsonl", [{"pred": "a"}]), lines(dump / "07x.jsonl", [{"pred": "b"}]), lines(dump / "10.jsonl", [{"pred": "c"}])
    assert sorted((r.step, r.pred) for r in records.step_files(spark, str(dump), "pred string").collect()) == [(7, "a"), (10, "c")]
    assert records.step_files(spark, str(dump / "10.jsonl"), "pred string").first().step == 10
    with pytest.raises(ValueError, match="named by its step"):
        records.step_files(spark, str(dump / "07x.jsonl"), "pred string")
    (dump / "11.jsonl").write_text("")
    with pytest.raises(ValueError, match="empty: 11.jsonl"):
        records.step_files(spark, str(dump), "pred string")
    for n in ("checkpoint-100", "checkpoint-20", "checkpoint-x", "other-3"):
        (tmp_path / "run" / n).mkdir(parents=True)
    (tmp_path / "run" / "checkpoint-5").write_text("a file")
    assert [r.step for r in records.checkpoints(spark, str(tmp_path / "run")).collect()] == [20, 100] and records.checkpoints(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "c.json").write_text("[1]")
    assert records.config(str(tmp_path / "c.json"), lenient=True) == records.config(str(tmp_path / "none.json"), lenient=True) == {}
    with pytest.raises(ValueError):
        records.config(str(tmp_path / "c.json"))
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"a": [1, 2]}))
    assert records.config(str(tmp_path / "c.yaml")) == {"a": [1, 2]}


@pytest.mark.parametrize(
    "row, error",
    [
        (GOOD, None), ({**GOOD, "label": True}, "bad_label"), ({**GOOD, "label": 2}, "bad_label"), ({**GOOD, "label": "1"}, "bad_label"), ({**GOOD, "content": []}, "bad_content"), ({**GOOD, "content": ""}, "bad_content"),
        ({**GOOD, "content": {}}, "bad_content"), ({**GOOD, "content": 5}, "bad_content"), ({**GOOD, "reason": "  "}, "bad_reason"), ({**GOOD, "source": " "}, "bad_source"), ({**GOOD, "more": 1}, "unknown_key"),
        ({"content": "x"}, "missing_key"), ([1], "not_object"), ({**GOOD, "content": None}, "bad_content"),
    ],
)
def test_record_errors(spark, row, error):
    df = spark.createDataFrame([(json.dumps(row),)], "raw string").withColumn("value", F.try_parse_json("raw"))
    assert df.select(records.record_error(F.col("value"), F.col("raw")).alias("e")).first().e == error


def test_array_and_specs(spark, tmp_path):
    p = tmp_path / "b.json"
    p.write_text(json.dumps([GOOD, GOOD, 3]), encoding="utf-8")
    good, bad = records.labelled(records.records(spark, str(p)), "b", "train")
    assert good.count() == 2 and bad.first().error == "not_object"
    assert records.source_spec("n = /x/y.jsonl".replace(" ", "")) == ("n", "/x/y.jsonl") and records.source_spec("/x/y.jsonl") == ("y", "/x/y.jsonl")
    with pytest.raises(ValueError):
        records.source_spec("=/x")
    assert records.files(spark, str(p)).first().size == p.stat().st_size
    with pytest.raises(Exception, match="not_object"):
        records.strict(records.records(spark, str(p)).withColumn("error", records.record_error(F.col("value"), F.col("raw")))).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "n int, s string, t string")
    assert sinks.write_jsonl(df, str(tmp_path / "o"), "n") == 2
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"n": 1, "s": "a", "t": "x"}, {"n": 2, "s": "b", "t": None}]
    assert sinks.digest(df) == sinks.digest(df.orderBy("n")) != sinks.digest(df.limit(1))
    for value in ({"b": 0}, {"b": 1, "a": "é"}):
        sinks.write_json(spark, str(tmp_path / "d" / "x.json"), value)
    assert json.loads((tmp_path / "d" / "x.json").read_text()) == {"a": "é", "b": 1} == sinks.read_json(spark, str(tmp_path / "d" / "x.json"))
    with pytest.raises(TypeError):
        sinks.write_json(spark, str(tmp_path / "d" / "x.json"), object())
    assert [x for x in os.listdir(tmp_path / "d") if not x.endswith(".crc")] == ["x.json"]
    (tmp_path / "new").mkdir(), (tmp_path / "old").mkdir()
    with pytest.raises(FileExistsError):
        sinks.swap(spark, str(tmp_path / "new"), str(tmp_path / "old"))
    sinks.swap(spark, str(tmp_path / "new"), str(tmp_path / "old"), overwrite=True)
    assert not (tmp_path / "new").exists()
    assert sinks.markdown([{"a": 0.5, "b": None}], ["a", "b"]) == "| a | b |\n|---|---|\n| 0.5000 | - |\n"


def test_publish(spark, tmp_path):
    target = str(tmp_path / "t")

    def good(folder):
        sinks.write_json(spark, f"{folder}/a.json", [1])

    def bad(folder):
        good(folder)
        raise RuntimeError("half way")

    with pytest.raises(RuntimeError):
        sinks.publish(spark, target, bad)
    assert os.listdir(tmp_path) == []
    sinks.publish(spark, target, good)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, target, good)
    with pytest.raises(RuntimeError):
        sinks.publish(spark, target, bad, overwrite=True)
    assert sinks.read_json(spark, f"{target}/a.json") == [1]
    sinks.publish(spark, target, lambda f: sinks.point(spark, f, "best", 5, "c/5"), overwrite=True)
    assert sinks.read_json(spark, f"{target}/best.json") == {"step": 5, "checkpoint": "c/5"} and os.listdir(tmp_path) == ["t"]
    (tmp_path / ".u.staging").mkdir()
    with pytest.raises(FileExistsError, match="another run"):
        sinks.publish(spark, str(tmp_path / "u"), good)
    assert (tmp_path / ".u.staging").exists()


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    schema = "source string, gold string, pred string"
    put = lambda k, *rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "state")
    for k in range(3):
        put(k, ("s", "safe", "safe"))
    assert incremental.stream_metrics(stream(), folder=folder).first().n == 3
    batches = len(os.listdir(f"{folder}/checkpoint/commits"))
    assert batches >= 3
    put(3, ("s", "unsafe", None), ("t", "safe", "safe"))
    assert {r.source: r.n for r in incremental.stream_metrics(stream(), folder=folder).collect()} == {"s": 4, "t": 1}
    # the last batch was put out but not committed when the process was killed: it is run again and replaces itself
    commits = [x for x in os.listdir(f"{folder}/checkpoint/commits") if x.isdigit()]
    last = max(commits, key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{folder}/checkpoint/commits/{name}"):
            os.remove(f"{folder}/checkpoint/commits/{name}")
    assert {r.source: r.n for r in incremental.stream_metrics(stream(), folder=folder).collect()} == {"s": 4, "t": 1}
    once = lambda: incremental.drained(incremental.once_each(stream().select("source"), ["source"]), "append", "once", str(tmp_path / "once"))
    assert once().count() == once().count() == 2


def test_retention_state_has_a_bound(spark, tmp_path):
    rows = [("r", s, kind, float(s % 7), 0.0, 0.0) for s in range(1, 31) for kind in ("save", "validation")] + [("r", 40, "save", None, None, None)]
    schema = "run string, step long, kind string, k1 double, k2 double, k3 double"
    for k, part in enumerate((rows[:30], rows[30:], [("r", 2, "save", None, None, None), ("r", 2, "validation", 99.0, 0.0, 0.0), ("r", 40, "validation", 1.0, 0.0, 0.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}/p"))
        s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in*"))
        out = incremental.drained(incremental.retention(s, most_waiting=5), "append", "r", str(tmp_path / "state")).collect()
    steps = [r.step for r in out]
    assert sorted(steps) == [*range(1, 31), 40] and {r.best_step for r in out if r.step == 40} == {6}


def test_retention_stream(spark, tmp_path):
    schema = "run string, step long, kind string, k1 double, k2 double, k3 double"
    parts = [
        [("r", 1, "validation", 0.8, 0.7, 0.7), ("r", 50, "save", None, None, None)],
        [("r", 1, "save", None, None, None), ("r", 1, "save", None, None, None)],
        [("r", 50, "validation", 0.9, 0.6, 0.8), ("r", 100, "validation", 0.9, 0.6, 0.8), ("r", 100, "save", None, None, None)],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = {r.step: r for r in incremental.drained(incremental.retention(stream), "append", "t").collect()}
    assert set(out) == {1, 50, 100}
    assert out[max(out)].best_step == 50 and max(r.latest_step for r in out.values()) == 100


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", "safe", "safe"), ("s", "unsafe", None), ("t", "safe", "unsafe")]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "source string, gold string, pred string").write.parquet(str(tmp_path / f"x/p{k}"))
    s = spark.readStream.schema("source string, gold string, pred string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "x"))
    from veritrace.operators.metrics import counts, rates

    batch = rates(spark.createDataFrame(rows, "source string, gold string, pred string").groupBy("source").agg(*counts()))
    assert sorted(map(tuple, incremental.stream_metrics(s).collect())) == sorted(map(tuple, batch.collect()))


def answer():
    return lambda prompts: [("<analysis>fine</analysis><label>safe</label>" if "hi" in p else "?", 1, 1) for p in prompts]


def test_cli(spark, tmp_path, capsys):
    train = [dict(GOOD, content=f"text {i}", label=int(i % 5 == 0)) for i in range(20)] + [dict(GOOD, content="text 1", label=0), dict(GOOD, content="held", label=0)]
    t, v = lines(tmp_path / "t.jsonl", train), lines(tmp_path / "v.jsonl", [dict(GOOD, content="held")])
    stop, spark.stop = spark.stop, lambda: None
    try:
        assert cli.main(["prepare", "--train", f"web={t}", "--validation", v, "--out", str(tmp_path / "out")]) == 0
        report = json.loads((tmp_path / "out/audit.json").read_text())
        assert (report["removed_overlap"], report["removed_duplicates"], report["labels"]) == (1, 1, {"0": 16, "1": 14})
        assert cli.main(["schedule", str(tmp_path / "out/train/manifest"), str(tmp_path / "sched"), "--rounds", "6"]) == 0
        assert spark.read.parquet(str(tmp_path / "sched")).count() == 12
        assert report["validation_rows"] == 1 and report["oversampling"] == {"ratio": 0.9, "before": {"0": 16, "1": 4}, "added": 10, "after": {"0": 16, "1": 14}}
        assert set(json.loads((tmp_path / "out/registry.json").read_text())) == {"train", "validation"}
        assert cli.main(["prepare", "--train", f"web={t}", "--validation", v, "--out", str(tmp_path / "out")]) == 1  # it is there
        assert cli.main(["prepare_rl", str(tmp_path / "out"), str(tmp_path / "rl"), "--rounds", "6"]) == 0
        summary = json.loads((tmp_path / "rl/summary.json").read_text())
        assert {k: x["records"] for k, x in summary["outputs"].items()} == {"train_unique": 20, "train_balanced": 12, "validation": 1} and summary["sampling_repeats"] == {"web/unsafe": 2}
        first = json.loads(min((tmp_path / "rl/train_balanced").glob("part-*")).read_text().splitlines()[0])
        assert first["extra_info"]["index"] == 0 and [m["role"] for m in first["prompt"]] == ["system", "user"] and first["reward_model"]["ground_truth"]["label"] == "safe"
        (tmp_path / "scripted_predictor.py").write_text("def load():\n    return lambda prompts: [('?', 1, 1) for p in prompts]\n\n\nagain = load\n")
        spark.sparkContext.addPyFile(str(tmp_path / "scripted_predictor.py"))  # as --py-files does
        score = ["evaluate", str(tmp_path / "out"), str(tmp_path / "eval"), "--predictor", "scripted_predictor:load"]
        assert cli.main([*score, "--sources", "v", "w"]) == 1 and cli.main(score) == 0
        document = json.loads((tmp_path / "eval/metrics.json").read_text())
        assert document["overall"]["n"] == 1 and document["overall"]["parsed"] == 0 and document["unparsed"] == "count_as_incorrect"
        assert cli.main(score) == 0  # nothing is left to score
        assert cli.main([*score[:3], "--predictor", "scripted_predictor:again"]) == 1 and "other settings" in capsys.readouterr().err
        bad = lines(tmp_path / "bad.jsonl", ["{"])
        assert cli.main(["prepare", "--train", bad, "--validation", v, "--out", str(tmp_path / "o2")]) == 1
        (tmp_path / "dump").mkdir()
        for step, pred in ((1, "safe"), (50, "unsafe")):
            lines(tmp_path / f"dump/{step}.jsonl", [{"pred": pred, "target_label": "unsafe", "parse_ok": 1.0, "source": "s"}, {"pred": "safe", "target_label": "safe"}])
        lines(tmp_path / "dump/notes.jsonl", [{"pred": "safe", "target_label": "unsafe"}])
        assert cli.main(["summarize", str(tmp_path / "dump"), "--all"]) == 0
        out = capsys.readouterr().out
        assert "step 50" in out and "| 1 | 2 |" in out and cli.main(["summarize", str(tmp_path / "dump"), "--step", "7"]) == 1
        one = tmp_path / "one.json"
        one.write_text(json.dumps({"content": [{"role": "user", "content": "hi"}]}))
        assert cli.main(["audit", str(one), "--predictor", "test_sources_streams:answer"]) == 0
        one.write_text(json.dumps({"content": "what"}))
        assert cli.main(["audit", str(one), "--predictor", "test_sources_streams:answer"]) == 2
    finally:
        spark.stop = stop


def test_scratch_deletes_what_was_written_inside(spark):
    from veritrace import runtime

    kept = runtime.materialize(spark.range(3).toDF("n"), "kept")
    with runtime.scratch(spark):
        gone = runtime.materialize(spark.range(4).toDF("n"), "gone")
        path = runtime._WRITTEN[-1]
        assert gone.count() == 4
    fs, at = runtime.file_system(spark, path)
    assert not fs.exists(at) and kept.count() == 3

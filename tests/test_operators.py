import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veritrace.functions import tensors
from veritrace.operators import curate, evaluate, metrics, skew, truncate


def items(spark, n=40):
    rows = [(i, "abc"[i % 3], f"h{i // 2}", i % 4 == 0 and 1 or 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, source string, sha string, label int")


def test_overlap_and_dedup(spark):
    train, held = items(spark), spark.createDataFrame([("h1",), ("h1",), (None,)], "sha string")
    left = curate.without_overlap(train.unionByName(spark.createDataFrame([(99, "a", None, 0)], train.schema)), held, "sha")
    assert {r.id for r in left.collect()} == {i for i in range(40) if i // 2 != 1} | {99}
    assert [r.sha for r in curate.overlap(train, held, "sha").collect()] == ["h1"]
    d = {r.sha: r for r in curate.dedup_exact(train, "sha", ["source", "id"]).collect()}
    assert len(d) == 20 and d["h0"].id == 0 and d["h0"].n_copies == 2 and d["h0"].n_labels == 2
    assert curate.label_conflicts(train, "sha").count() == 10


@pytest.mark.parametrize("safe, unsafe, ratio, extra", [(10, 3, 0.9, 6), (5, 1, 0.9, 3), (2, 9, 0.9, 0), (3, 0, 0.5, 0), (0, 3, 0.5, 0)])
def test_oversample(spark, safe, unsafe, ratio, extra):
    df = spark.createDataFrame([(i, int(i >= safe)) for i in range(safe + unsafe)], "id long, label int")
    out = curate.oversample(df, 7, ratio, "id").collect()
    assert len(out) == safe + unsafe + extra
    copies = Counter((r.oversample_copy, r.id) for r in out if r.oversample_copy)
    assert all(n == 1 for n in copies.values())
    per = Counter(c for c, _ in copies)
    assert [per[c] for c in sorted(per)] == ([unsafe] * (extra // unsafe) + [extra % unsafe] * (extra % unsafe > 0) if extra else [])
    with pytest.raises(ValueError):
        curate.oversample(df, 7, 1.0, "id")


def test_schedule_against_loop(spark):
    pools = {("x", "safe"): 10, ("x", "unsafe"): 3, ("y", "safe"): 20, ("y", "unsafe"): 3}
    rows = [(k, s, y) for k, (s, y) in enumerate(p for p, n in pools.items() for _ in range(n))]
    got = curate.balanced_schedule(spark.createDataFrame(rows, "id long, source string, label string"), 12, 5, "id").collect()
    want, index = {}, 0
    state = {p: (0, []) for p in pools}
    for draw in range(12):
        order = sorted(pools)
        for p in order if draw % 2 == 0 else order[::-1]:
            cycle, left = state[p]
            if not left:
                left = sorted((k for k, s, y in rows if (s, y) == p), key=lambda k: hashlib.sha256(f"5|{cycle}|{k}".encode()).hexdigest())
                cycle += 1
            want[index] = (left[0], draw, draw >= pools[p])
            state[p] = (cycle, left[1:])
            index += 1
    assert {r.prepared_index: (r.id, r.draw, r.is_repeat) for r in got} == want


def test_strata_and_ranked(spark):
    df = spark.createDataFrame([(1, "a", "safe"), (2, "b", "unsafe"), (3, None, "safe")], "id long, source string, label string")
    assert {(r.source, r.label): r.n for r in curate.strata(df).collect()} == {("a", "safe"): 1, ("a", "unsafe"): 0, ("b", "safe"): 0, ("b", "unsafe"): 1}
    h = spark.range(500).withColumn("o", F.sha2(F.col("id").cast("string"), 256))
    got = {r.id: r.line for r in curate.ranked(h, [F.col("o"), F.col("id")]).collect()}
    order = sorted(range(500), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_metrics_cases(spark):
    rows = [("safe", "safe"), ("safe", None), ("unsafe", "unsafe"), ("unsafe", "safe")]
    m = metrics.metrics(spark.createDataFrame([("Overall", *r) for r in rows], "source string, gold string, pred string")).collect()
    assert len(m) == 2 and {r.is_overall for r in m} == {True, False}
    r = m[0]
    assert (r.accuracy, r.parse_rate, r.safe_precision, r.safe_recall, r.unsafe_precision, r.unsafe_recall) == (0.5, 0.75, 0.5, 0.5, 1.0, 0.5)
    assert math.isclose(r.macro_f1, (0.5 + 2 / 3) / 2, abs_tol=1e-8)
    none = metrics.metrics(spark.createDataFrame([("s", "safe", None)] * 3, "source string, gold string, pred string")).first()
    assert none.accuracy == none.macro_f1 == 0
    assert metrics.confusion(spark.createDataFrame([("s", *r) for r in rows], "source string, gold string, pred string"), ["source"]).first().confusion == "gold_safe__pred_safe=1;gold_safe__pred_unparseable=1;gold_unsafe__pred_safe=1;gold_unsafe__pred_unsafe=1"


def test_selection(spark):
    keys = spark.createDataFrame([(1, 0.8, 0.7, 0.7), (50, 0.9, 0.6, 0.8), (100, 0.9, 0.6, 0.8)], "step int, overall_macro_f1 double, least_macro_f1 double, least_recall double")
    assert tuple(metrics.best_and_latest(keys).first()) == (50, 100)
    assert [tuple(r) for r in metrics.running_best(keys).orderBy("step").collect()] == [(1, 1, 1), (50, 50, 50), (100, 50, 100)]
    assert [r.step for r in metrics.pruned(keys).collect()] == [1]


def test_advantage_and_regions(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate((1.0, -1.0, -1.25, 1.0))], "id int, reward double").withColumn("b", F.lit(1))
    assert [r.advantage for r in tensors.centred_advantage(df, "b").orderBy("id").collect()] == [1.0625, -0.9375, -1.1875, 1.0625]
    masks = spark.createDataFrame([(0, [True] * 3 + [False] * 2), (1, [True] * 20), (2, [False] * 4)], "id int, m array<boolean>")
    m = F.col("m")
    out = masks.select(tensors.label_region(m).alias("l"), tensors.analysis_region(m).alias("a"), tensors.terminal_reward(F.lit(5.0), m).alias("t"), tensors.masked_mean(F.transform(m, lambda _: F.lit(2.0)), tensors.analysis_region(m)).alias("x")).collect()
    assert out[0].l == [True] * 3 + [False] * 2 and not any(out[0].a) and out[0].t == [0, 0, 5, 0, 0] and out[0].x == 0
    assert out[1].a == [True] * 8 + [False] * 12 and out[1].x == 2
    assert out[2].t == [5, 0, 0, 0] and not any(out[2].l)


def test_losses_against_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        n, v = 26, rng.randrange(0, 25)
        rows.append((i, i % 2, rng.uniform(-1, 1), [rng.uniform(-3, 0) for _ in range(n)], [rng.uniform(-3, 0) for _ in range(n)], [k < v for k in range(n)]))
    df = spark.createDataFrame(rows, "id int, b int, advantage double, new array<double>, old array<double>, mask array<boolean>")
    got = {r.b: r for r in tensors.region_loss(df.withColumn("terms", tensors.clipped_terms(F.col("new"), F.col("old"), F.col("advantage"), 0.2, 0.3)), "b").collect()}
    for b in (0, 1):
        means = []
        for _, g, adv, new, old, mask in rows:
            if g == b:
                terms = [-max(0.8, min(1.3, math.exp(max(-20, min(20, x - y))))) * adv * x for x, y in zip(new, old)]
                v = sum(mask)
                cut = max(v - 12, 0)
                mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
                means.append((mean(terms[:cut]), mean(terms[cut:v])))
        a, l = (sum(x[k] for x in means) / len(means) for k in (0, 1))
        assert math.isclose(got[b].loss, a + 2 * l, abs_tol=1e-8) and math.isclose(got[b].label_loss, l, abs_tol=1e-8)
    w = df.select("id", tensors.weighted_mean_loss(F.transform("new", lambda x: -x), F.col("mask"), 3, 4.0).alias("w")).collect()
    for r, row in zip(sorted(w), rows):
        valid = [-x for x, m in zip(row[3], row[5]) if m]
        ws = [4.0 if k >= len(valid) - 3 else 1.0 for k in range(len(valid))]
        assert math.isclose(r.w, sum(x * y for x, y in zip(valid, ws)) / max(1, sum(ws)), abs_tol=1e-9)
    d = {r.b: r for r in tensors.loss_diagnostics(df, "b", 0.2, 0.3).collect()}
    pairs = [x - y for _, g, _, new, old, mask in rows if g == 0 for x, y, m in zip(new, old, mask) if m]
    assert math.isclose(d[0].kl, -sum(pairs) / len(pairs), abs_tol=1e-8)


def test_ids(spark):
    df = spark.createDataFrame([([3, -1, 3, 0, 0],), ([0, 0],), ([],)], "x array<int>")
    out = df.select(tensors.without_padding(F.col("x"), 0).alias("p"), tensors.distinct_ids(F.col("x")).alias("d"), tensors.prefix_ids(F.col("x"), 2).alias("f")).collect()
    assert [r.p for r in out] == [[3, -1, 3], [], []] and out[0].d == [3, 0] and out[0].f.ids == [3, -1] and out[0].f.truncated and not out[1].f.truncated


def test_bookkeeping(spark):
    items_ = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "dataset_index int, source string")
    done = spark.createDataFrame([(0, "x"), (0, "x"), (1, "x"), (1, "y")], "dataset_index int, source string")
    assert {r.dataset_index for r in evaluate.pending(items_, done).collect()} == {2, 3}
    assert [(r.dataset_index, r.n_rows, r.n_versions) for r in evaluate.conflicts(done, ["dataset_index"]).collect()] == [(1, 2, 2)]
    assert evaluate.provenance_mismatch(done, items_, ["dataset_index"], ["source"]).count() == 4
    a, b = (spark.createDataFrame(x, "name string, value string") for x in ([("k", "1"), ("l", "2")], [("k", "1"), ("l", None), ("m", "3")]))
    assert {r.name for r in evaluate.resume_differences(a, b).collect()} == {"l", "m"}

    def load():
        return lambda prompts: [(p.upper(), len(p), 1) for p in prompts]

    assert {r.prediction for r in evaluate.score(items_.withColumn("prompt", F.col("source")), load, batch=3).collect()} == {"S0", "S1", "S2", "S3"}


def test_truncation(spark):
    chats = [[("system", "a b"), ("user", "one two three four")], [("system", "x")], None, [("system", "w " * 9), ("user", "y")], [("system", None), ("user", None)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "id int, messages array<struct<role:string,content:string>>")
    out = {r.id: r for r in truncate.with_truncation(df, 6).collect()}
    best = max(n for n in range(19) if truncate.words_counter([{"content": "a b"}, {"content": "one two three four"[:n]}]) <= 6)
    assert out[0].messages[1].content == "one two three four"[:best] and out[0].prompt_right_truncated and out[0].prompt_visible_tokens == 6
    assert [out[k].prompt_error for k in (1, 2, 3, 4)] == [None, "not_a_list", "fixed_part_too_long", None]
    c = df.filter("messages is not null").select("id", truncate.truncated_chars(F.col("messages"), 8).alias("t")).collect()
    assert c[0].t.last_user == "one t" and c[0].t.truncated and c[0].t.original == 21
    with pytest.raises(ValueError):
        truncate.right_truncated(F.col("messages"), 0)


def test_skew_join(spark):
    many = spark.range(3000).select((F.when(F.col("id") < 1500, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([(None, 1)], "k long, x long"))
    few = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")).unionByName(spark.createDataFrame([(None, 1)], "k long, y long"))
    assert skew.hot_keys(many, ["k"], 0.01, 10).collect()[0].k == 0
    got = sorted(map(tuple, skew.skew_join(many, few, ["k"], salts=5, share=0.01, least=10).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, many.join(few, "k").select("k", "x", "y").collect()))
    for limit in (5, 10_000):
        assert skew.semi_checked(many, few.select("k").distinct(), "k", limit=limit).count() == many.join(few, "k", "left_semi").count()
        assert skew.semi_checked(many, few.select("k").distinct(), "k", limit=limit, how="left_anti").count() == many.join(few, "k", "left_anti").count()


def test_empty_tables(spark):
    none = items(spark).limit(0)
    assert curate.oversample(none, 1, 0.5, "id").count() == 0
    assert curate.dedup_exact(none, "sha", ["id"]).count() == 0
    assert curate.balanced_schedule(none.withColumn("label", F.lit("safe")), 4, 1, "id").count() == 0
    assert metrics.metrics(none.select("source", F.lit("safe").alias("gold"), F.lit(None).cast("string").alias("pred"))).filter("n > 0").count() == 0


def test_ranked_inside_hot_keys(spark):
    rows = [(k, i % 50 if i % 3 else None, i) for k, n in (("hot", 900), ("small", 7), (None, 300)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = [F.col("v"), F.col("i")]
    want = {(r.k, r.i): r.line for r in curate.ranked(df, order, by=["k"]).collect()}
    got = curate.ranked(df, order, by=["k"], rows_a_cell=60)
    assert {(r.k, r.i): r.line for r in got.collect()} == want and len(want) == len(rows) and got.columns == ["k", "v", "i", "line"]
    hashed = df.withColumn("o", curate.seeded_order(1, F.col("k"), F.col("i")))
    lines = [r.line for r in curate.ranked(hashed, [F.col("o")], buckets=4, rows_a_cell=20).orderBy("o").collect()]
    assert lines == list(range(1, len(rows) + 1))


def test_consolidated_and_union(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, None, None), (2, None, None)], "k int, s string, long_text string")
    assert sorted(map(tuple, evaluate.consolidated(df, ["k", "s"]).collect()), key=str) == [(1, "a"), (1, "a"), (2, None)]
    assert evaluate.consolidated(df).count() == 3
    u = spark.createDataFrame([(["a", "b", "a"], ["c", "a", "c"]), (None, ["x"]), (["y"], None)], "p array<string>, q array<string>")
    assert [r.u for r in u.select(curate.ordered_union(F.col("p"), F.col("q")).alias("u")).collect()] == [["a", "b", "a", "c"], ["x"], ["y"]]

"""Queries over token sequences against loops over every token of an answer, long ones included."""

import math

import pytest
from pyspark.sql import functions as F

from veritrace.plans import queries as core

LENGTHS = [0, None, 1, 11, 12, 13, 22, 23, 63, 64, 65, 76, 77, 200, 384]


@pytest.fixture(scope="module")
def answers(spark, sf, tmp_path_factory):
    """The folder, and for each answer (audit_id, source, advantage, tokens)."""
    folder = str(tmp_path_factory.mktemp("answers"))
    length = F.element_at(F.array(*[F.lit(n).cast("int") for n in LENGTHS]), (F.col("audit_id") % len(LENGTHS) + 1).cast("int"))
    spark.read.parquet(f"{sf}/audit_result.parquet").withColumn("generated_tokens", length).write.parquet(f"{folder}/audit_result.parquet")
    reward = {r.audit_id: r.reward for r in core.queries()["reward_score"](spark, folder).collect()}
    rows = {r.audit_id: r for r in spark.read.parquet(f"{folder}/audit_result.parquet").select("audit_id", "source", "generated_tokens").collect() if r.audit_id in reward}
    of = {}
    for r in rows.values():
        of.setdefault(r.source, []).append(reward[r.audit_id])
    mean = {s: sum(x) / len(x) for s, x in of.items()}
    out = [(i, r.source, reward[i] - mean[r.source], r.generated_tokens or 0) for i, r in rows.items()]
    assert max(n for *_, n in out) == 384
    return folder, out, reward


def logps(i, n):
    return [-((i * 31 + k * 17) % 97) / 40.0 for k in range(n)], [-((i * 29 + k * 13) % 89) / 37.0 for k in range(n)]


def mean(x):
    return sum(x) / len(x) if x else 0.0


def test_regions(spark, answers):
    folder, rows, reward = answers
    got = {r.audit_id: r for r in core.queries()["token_regions"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, _, advantage, n in rows:
        r = got[i]
        assert (r.length, r.valid, r.reward_at, r.label_tokens, r.analysis_tokens) == (n + 4, n, max(n - 1, 0), min(n, 12), max(n - 12, 0))
        assert r.reward_sum == reward[i] and r.advantage_sum == pytest.approx(advantage * n, abs=2e-6)


def test_losses(spark, answers):
    folder, rows, _ = answers
    per, ce = {}, {}
    for i, source, advantage, n in rows:
        new, old = logps(i, n)
        ratios = [math.exp(a - b) for a, b in zip(new, old)]
        terms = [-max(min(r, 1 + core.HIGH), 1 - core.LOW) * advantage * a for r, a in zip(ratios, new)]
        at = max(n - 12, 0)
        per.setdefault(source, []).append((mean(terms[:at]), mean(terms[at:]), ratios, advantage))
        weights = [4.0 if k >= n - 12 else 1.0 for k in range(n)]
        ce[i] = sum(-a * w for a, w in zip(new, weights)) / max(sum(weights), 1)
    loss = {r.source: r for r in core.queries()["region_loss"](spark, folder).collect()}
    diagnostics = {r.source: r for r in core.queries()["loss_diagnostics"](spark, folder).collect()}
    assert set(loss) == set(diagnostics) == set(per)
    for source, x in per.items():
        a, label, ratios = mean([y[0] for y in x]), mean([y[1] for y in x]), [r for y in x for r in y[2]]
        r, g = loss[source], diagnostics[source]
        assert (r.analysis_loss, r.label_loss, r.loss) == pytest.approx((a, label, a + 2 * label), abs=2e-6) and r.n == len(x)
        clipped = mean([float(y < 1 - core.LOW or y > 1 + core.HIGH) for y in ratios])
        assert (g.kl, g.clip_share) == pytest.approx((mean([-math.log(y) for y in ratios]), clipped), abs=2e-6)
        assert (g.active_share, g.mean_abs_advantage) == pytest.approx((mean([float(abs(y[3]) > 1e-12) for y in x]), mean([abs(y[3]) for y in x])), abs=2e-6)
    got = {r.audit_id: r.loss for r in core.queries()["weighted_ce"](spark, folder).collect()}
    assert got == pytest.approx(ce, abs=2e-6)


def test_ids(spark, answers):
    folder, _, _ = answers
    got = {r.audit_id: r for r in core.queries()["token_ids"](spark, folder).collect()}
    tokens = {r.audit_id: r.generated_tokens or 0 for r in spark.read.parquet(f"{folder}/audit_result.parquet").collect()}
    assert set(got) == set(tokens)
    for i, g in tokens.items():
        ids = [0 if k >= g - g % 5 else (i + k * k) % 11 - 1 for k in range(g + 1)]
        bare = list(ids)
        while bare and bare[-1] == 0:
            bare.pop()
        r = got[i]
        assert (r.n, r.n_padding_before, r.n_distinct, r.prefix_sum, r.truncated) == (len(ids), len(bare), len({x for x in ids if x >= 0}), sum(ids[:8]), len(ids) > 8)

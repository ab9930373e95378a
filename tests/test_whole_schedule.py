"""The schedule of a whole epoch against a loop."""

import hashlib

from veritrace.plans import queries as core


def test_epoch(spark, sf):
    pools: dict[tuple, list] = {}
    for r in core._rl(spark, sf).select("rl_id", "source", "label").collect():
        if r.source is not None and r.label in ("safe", "unsafe"):
            pools.setdefault((r.source, r.label), []).append(r.rl_id)
    strata, want = sorted(pools), {}
    for k, stratum in enumerate(strata):
        n, order = len(pools[stratum]), {}
        for draw in range(512):
            cycle = draw // n
            if cycle not in order:
                order[cycle] = sorted(pools[stratum], key=lambda i: (hashlib.sha256(f"{core.SEED}|{cycle}|{i}".encode()).hexdigest(), i))
            at = draw * len(strata) + (k if draw % 2 == 0 else len(strata) - 1 - k)
            want[at] = (order[cycle][draw % n], *stratum, draw, draw >= n)
    got = core.queries()["balanced_schedule"](spark, sf).collect()
    assert len(got) == len(want)
    assert {r.prepared_index: (r.rl_id, r.source, r.label, r.draw, r.is_repeat) for r in got} == want
    repeats = {(r.source, r.label): (r.draws, r.repeats) for r in core.queries()["schedule_repeats"](spark, sf).collect()}
    assert repeats == {s: (512, max(0, 512 - len(x))) for s, x in pools.items()}

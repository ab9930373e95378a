import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrace.llm import mixing, splitting


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .\n{},表。", max_size=400), st.integers(1, 60), st.integers(0, 80), st.lists(st.integers(0, 400), max_size=4))
def test_pieces_put_together(text, limit, overlap, joints):
    found = splitting.pieces(text, sorted(j for j in joints if j <= len(text)), limit, overlap)
    out, last = "", 0
    for k, (a, b, _) in enumerate(found):
        assert 0 <= a < b or not text
        assert b - a <= limit
        if k:
            assert last - a == min(overlap, limit - 1)
        out += text[max(a, last) : b]
        last = b
    assert out == text and last == len(text)


def test_cut_where_the_subject_changes():
    one = "The lock file of the queue was stale. " * 8
    two = "Olive oil and ripe tomatoes make a sauce. " * 8
    cut = splitting.pieces(one + two, [], len(one) + 90, 20)[0]
    assert cut[1] == len(one) and cut[2] == splitting.SENTENCE
    assert splitting.pieces("word " * 50, [], 52, 0)[0][1:] == (50, splitting.WORD)
    assert splitting.pieces("x" * 100, [], 30, 5) == [(0, 30, 0), (25, 55, 0), (50, 80, 0), (75, 100, 0)]


def test_cut_in_the_first_part_before_a_hard_one():
    run = "x" * 40
    assert splitting.pieces("one two " + run, [], 40, 0) == [(0, 8, splitting.WORD), (8, 48, 0)]
    assert splitting.pieces("End. one " + run, [], 40, 0)[0] == (0, 5, splitting.SENTENCE)
    assert splitting.pieces("ab" + run, [2], 40, 0)[0] == (0, 2, splitting.EVENT)
    assert splitting.pieces("表单" + run, [], 40, 0)[0] == (0, 1, splitting.WORD)
    # a gap within the overlap would begin the same piece again
    assert splitting.pieces("one two " + run, [], 40, 8)[0] == (0, 40, 0)
    assert splitting.pieces("one two " + run, [], 40, 7)[:2] == [(0, 8, splitting.WORD), (1, 8 + 33, 0)]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="xxxxxxxx .\n表", max_size=300), st.integers(2, 60), st.integers(0, 30))
def test_hard_cuts_only_without_a_gap(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    for a, b, strength in splitting.pieces(text, [], limit, overlap)[:-1]:
        if strength == splitting.NONE:
            assert b == a + limit and not splitting.natural_gaps(text, []).keys() & set(range(a + overlap + 1, b + 1))
            assert not any(a + overlap < m.end() <= b for m in splitting._GAP.finditer(text))


def test_split_items(spark):
    rows = [
        (1, " s ", [("system", "a" * 30), ("user", "b " * 40)]), (2, "s", [("user", "x" * 50)]), (3, "s", [("user", "x" * 51)]), (4, "none", [("user", "x" * 500)]), (5, "s", None), (6, "s", []), (7, "s", [("user", None), ("user", "y" * 60), None]),
        (1, " s ", [("system", "a" * 30), ("user", "b " * 40)]), (None, "s", [("user", "x" * 99)]), (8, "t", [("user", "z" * 9)]), (9, None, [("user", "z" * 999)]), (10, "s", [("user", "😀" * 50)]), (11, "u", [("user", "z" * 9)]), (12, "big", [("user", "A b. " * 40_000)]),
    ]
    items = spark.createDataFrame([(*r, 1, "t") for r in rows], "rl_id long, source string, messages array<struct<role:string,content:string>>, piece int, max_chars string")
    limits = spark.createDataFrame([("s", 50, 10), ("s", 60, 0), ("t", 0, 1), ("u", 4, None), ("v", None, 3), (None, 3, 3), ("big", 1000, 100)], "source string, max_chars int, overlap_chars int")
    got = splitting.split_items(items, limits).collect()
    assert {r.rl_id for r in got} == {1, 3, 7, 11, 12} == {r.rl_id for r in splitting.oversized(items, limits).collect()}
    text = {1: "a" * 30 + "b " * 40, 3: "x" * 51, 7: "y" * 60, 11: "z" * 9, 12: "A b. " * 40_000}
    for i, t in text.items():
        mine = sorted((r for r in got if r.rl_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(mine[0].n_pieces))
        assert "".join(r.text[r.overlap :] for r in mine) == t
        assert all(t[r.first_char : r.end_char] == r.text for r in mine)
    assert [r.cut_at for r in got if r.rl_id == 1 and r.piece == 0] == ["event"]
    differ = items.limit(0).unionByName(spark.createDataFrame([(1, "s", [("user", "y" * 55)], 1, "t"), (1, "s", [("user", "y" * 55)], 2, "t"), (1, "s", [("user", "z" * 70)], 1, "t")], items.schema))
    again = splitting.split_items(differ, limits).collect()
    assert sorted((r.piece, r.n_pieces, r.text[0]) for r in again) == [(0, 2, "y"), (0, 2, "z"), (1, 2, "y"), (1, 2, "z")]
    measured = spark.createDataFrame([(1, 5, None), (1, 9, True), (2, None, True), (99, 1, True)], "rl_id long, original_tokens int, truncated boolean")
    report = {r.source: r for r in splitting.split_report(items, limits, measured).collect()}
    assert report["s"].n_split == 3 and report["s"].max_tokens == 9 and report["s"].n_flagged_not_split == 1
    assert splitting.split_items(items.limit(0), limits).count() == splitting.split_items(items, limits.limit(0)).count() == 0


def cost(flow):
    return sum((u - 1) * f for (_, u, _), f in flow.items())


def test_flow_against_all_routings():
    rng = random.Random(6)
    for _ in range(40):
        sources = ["a", "b"]
        uses = {s: rng.randrange(1, 3) for s in sources}
        patterns = {k: (p, rng.randrange(0, 4)) for k, p in enumerate((["a"], ["b"], ["a", "b"]))}
        supply = {(k, u): c for k, (p, c) in patterns.items() for u in range(1, max(uses[s] for s in p) + 1)}
        routes = {(k, u): [s for s in patterns[k][0] if uses[s] >= u] for k, u in supply}
        quota = {s: rng.randrange(0, 6) for s in sources}
        flow = mixing.min_cost_flow(dict(supply), routes, quota)
        best = (0, 0)
        nodes = sorted(supply)
        choices = [[(x, y) for x in range(supply[n] + 1) for y in range(supply[n] + 1 - x) if ("a" in routes[n] or not x) and ("b" in routes[n] or not y)] for n in nodes]
        for pick in itertools.product(*choices):
            x, y = sum(p[0] for p in pick), sum(p[1] for p in pick)
            if x <= quota["a"] and y <= quota["b"]:
                best = max(best, (x + y, -sum((n[1] - 1) * sum(p) for n, p in zip(nodes, pick))))
        assert (sum(flow.values()), -cost(flow)) == best
        for n in nodes:
            assert sum(f for (k, u, _), f in flow.items() if (k, u) == n) <= supply[n]


def test_flow_with_many_sources_and_patterns():
    rng = random.Random(5)
    names = [f"s{i:03d}" for i in range(80)]
    patterns = {}
    while len(patterns) < 3000:
        p = tuple(sorted(set(rng.choices(names, k=rng.randrange(1, 5)))))
        patterns[p] = (list(p), rng.randrange(1, 10**6))
    targets = {s: (rng.random() + 0.1, rng.randrange(1, 4)) for s in names}
    flow, shares = mixing.plan_mixture(patterns, targets)
    got = dict.fromkeys(names, 0)
    used = dict.fromkeys(((p, u) for p, u, _ in flow), 0)
    for (p, u, s), f in flow.items():
        assert f > 0 and s in p and u <= targets[s][1]
        got[s] += f
        used[p, u] += f
    total = sum(got.values())
    assert all(f <= patterns[p][1] for (p, _), f in used.items())
    assert all(got[s] / total == pytest.approx(shares[s], rel=1e-3) for s in names)


def rows_for(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        s = rng.choices(("big", "mid ", "\tsmall", "unlisted"), (60, 25, 5, 10))[0]
        rows.append((i, s, "train" if rng.random() < 0.9 else "test", "x" * rng.randrange(20, 60) + str(i if rng.random() < 0.8 else rng.randrange(30)), rng.choice((0, 1, None))))
    rows += [(5000, "big", "train", None, 1), (5001, "big", "train", "", 1), (5002, None, "train", "abc", 1), (None, "big", "train", "abc", 1), (0, "big", "train", "other text of a repeated id", 1)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "item_id long, source string, source_split string, content string, label int, chars int, pattern int, uses int")


def test_mixture(spark, monkeypatch):
    items = rows_for(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 5), ("absent", 0.05, 5), (None, 0.2, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(items, targets).collect()
    most = {"big": 1, "mid": 2, "small": 5}
    assert all(1 <= r.uses <= most[r.source] for r in got) and len({(r.item_id, r.source) for r in got}) == len(got)
    total = sum(r.chars * r.uses for r in got)
    for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert sum(r.chars * r.uses for r in got if r.source == s) / total == pytest.approx(t / 0.95, abs=0.02)
    content = {r.item_id: r.content for r in items.collect() if r.item_id}
    uses: dict[str, int] = {}
    for r in got:
        if r.item_id:
            uses[content[r.item_id]] = uses.get(content[r.item_id], 0) + r.uses
    assert max(uses.values()) <= 5
    assert sorted(map(tuple, mixing.mixture(items, targets).collect())) == sorted(map(tuple, got))
    # patterns beyond the largest stand for two of their sources: no record is left out, shares are still met
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    fewer = mixing.mixture(items, targets).collect()
    whole = sum(r.chars * r.uses for r in fewer)
    assert all(sum(r.chars * r.uses for r in fewer if r.source == s) / whole == pytest.approx(t / 0.95, abs=0.02) for s, t in (("big", 0.5), ("mid", 0.3), ("small", 0.15)))
    many = spark.createDataFrame([(f"x{k}", 0.001, 1) for k in range(130)], targets.schema)
    assert {r.source for r in mixing.mixture(items, targets.unionByName(many)).collect()} == {"big", "mid", "small"}
    monkeypatch.undo()
    shares = {(r.source, r.label_level): r for r in mixing.mixture_shares(items, targets).collect() if r.label_level == 0}
    assert shares["absent", 0].share == 0 and shares["small", 0].share == pytest.approx(0.15 / 0.95, abs=0.02) and shares["big", 0].most_uses == 1
    assert mixing.mixture(items.limit(0), targets).count() == mixing.mixture(items, targets.limit(0)).count() == 0


def test_mixture_with_many_patterns(spark, monkeypatch):
    rng = random.Random(4)
    sets = [("a",)] * 100 + [("a", "b", "c", "d")] * 60 + [tuple(rng.sample("abcd", 3)) for _ in range(40)]
    rows = [(10 * i + k, s, "train", f"{i:03d}" + "x" * rng.randrange(20, 40), k) for i, of in enumerate(sets) for k, s in enumerate(of)]
    rows = [(i, s, t, rows[j - k][3], k) for j, (i, s, t, _, k) in enumerate(rows)]  # records of one document have its content
    schema = "item_id long, source string, source_split string, content string, label int"
    wanted = {"a": 0.4, "b": 0.2, "c": 0.2, "d": 0.2}
    targets = spark.createDataFrame([(s, t, 2) for s, t in wanted.items()], "source string, target_share double, max_repeats int")
    for mine in (rows, [r for r in rows if r[0] < 1600]):  # the second without the patterns of three
        items = spark.createDataFrame(mine, schema)
        monkeypatch.undo()
        whole = sorted(map(tuple, mixing.mixture(items, targets).collect()))
        total = sum(r[3] * r[4] for r in whole)
        assert all(sum(r[3] * r[4] for r in whole if r[1] == s) / total == pytest.approx(t, abs=0.02) for s, t in wanted.items())
        monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
        assert sorted(map(tuple, mixing.mixture(items, targets).collect())) == whole

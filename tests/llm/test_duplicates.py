import itertools
import json
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrace.llm import cross_split as C
from veritrace.llm import format_dups as D
from veritrace.llm.records import bare_key, words

SCHEMA = "item_id long, source string, source_split string, content string, k1 int, id int, text string, n int"


def table(spark, rows):
    """Extra columns clash with the names that the operators use inside."""
    return spark.createDataFrame([(i, "s", sp, c, 1, 2, "t", 3) for i, sp, c in rows], SCHEMA)


def respelled(rng, value):
    """The same record written another way."""
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return {k: respelled(rng, v) for k, v in items}
    if isinstance(value, list):
        return [respelled(rng, v) for v in value]
    if isinstance(value, str):
        x = "".join(rng.choice((" ", "  ", "\n", " ", ", ")) if c == " " else c for c in value)
        return rng.choice((x, x.upper(), x.lower(), x.title()))
    return value


def spelled(rng, value):
    return json.dumps(respelled(rng, value), ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1, "\t")), separators=rng.choice(((",", ":"), (" , ", " : "))))


def event(rng):
    vocabulary = "the agent größer renamed é 7 file 表 单 queue x12 a b".split()
    return {"role": rng.choice(("user", "agent")), "content": " ".join(rng.choice(vocabulary) for _ in range(12)), "arguments": {"limit": rng.randrange(99), "ok": rng.choice((True, None))}}


def test_formatting_only(spark):
    rng = random.Random(5)
    base = [[event(rng) for _ in range(3)] for _ in range(15)] + ["plain text, no. {} %d".replace("{}", str(i)) for i in range(5)]
    rows, truth, i = [], {}, 100
    for k, b in enumerate(base):
        for _ in range(1 + k % 4):
            i -= 1
            rows.append((i, "train", spelled(rng, b) if not isinstance(b, str) else respelled(rng, b)))
            truth.setdefault(k, []).append(i)
    swapped = json.dumps(base[1][::-1])
    digit = json.dumps(base[2]).replace('"limit": ', '"limit": 1', 1)
    rows += [(200, "test", swapped), (201, "test", digit), (202, "train", None), (203, "train", None), (204, "train", ""), (205, "x", " \n"), (206, "x", "{broken"), (207, "x", '["a","b"]'), (208, "x", '["ab"]'), (206, "x", "{broken")]
    want = {(min(v), x) for v in truth.values() for x in v if x != min(v)} | {(204, 205)}
    got = [tuple(r) for r in D.superfluous_pairs(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    kept = {r.item_id: r.n_copies for r in D.distinct_records(table(spark, rows)).collect()}
    assert set(kept) == {r[0] for r in rows if r[2] is not None} - {b for _, b in want}
    assert all(kept[min(v)] == len(v) for v in truth.values())


def test_classes_are_coarser_than_keys(spark):
    rng = random.Random(9)
    texts = [spelled(rng, [event(rng)]) for _ in range(5)]
    many = [spelled(rng, json.loads(t)) for t in texts for _ in range(8)] + ["STRASSE ΟΔΟΣ", "straße οδος", "Straße, οΔος!"]
    df = D.cheap_class(spark.createDataFrame([(k, t) for k, t in enumerate(many)], "i int, t string"), "t", "c").collect()
    of: dict[bytes, set[int]] = {}
    for r in df:
        of.setdefault(bare_key(many[r.i]), set()).add(r.c)
    assert all(len(x) == 1 for x in of.values())


#: Texts that differ only in formatting: backslashes in plain text, and text that begins with a JSON value but doesn't end there.
ALIKE = [
    ["open C:\\new\\temp now", "open C:/new/temp now", "OPEN c new temp now", "[open C:\\new\\temp now"],
    ["say \\u00e9 twice", "say u00e9, twice"],
    ["[1] some text here", "1 some text here", "[1]: Some text here!", " [1]] some text here"],
    ['{"a":"x"}\n{"b":"y"}', "a x b y", '{"a":"x"},{"b":"y"}', '{"a":"x"} {"b":"Y"} !'],
    ['["caf\\u00e9 \\n"]\ufeff', 'caf\\u00e9 \\n', '["caf\\u00e9 \\n"] ;'],
    ['["é\\n",{"k":"\\\\n"}]', '\ufeff[ "\\u00C9" , {"K":"N"} ] '],
]


def test_text_that_only_begins_like_json(spark):
    texts = [(10 * k + i, t) for k, group in enumerate(ALIKE) for i, t in enumerate(group)]
    assert all(len({bare_key(t) for t in group}) == 1 for group in ALIKE) and len({bare_key(group[0]) for group in ALIKE}) == len(ALIKE)
    of: dict[int, set[int]] = {}
    for r in D.cheap_class(spark.createDataFrame(texts, "i int, t string"), "t", "c").collect():
        of.setdefault(r.i // 10, set()).add(r.c)
    assert all(len(x) == 1 for x in of.values()), of
    got = {tuple(r) for r in D.superfluous_pairs(table(spark, [(i, "x", t) for i, t in texts])).collect()}
    assert got == {(10 * k, 10 * k + i) for k, group in enumerate(ALIKE) for i in range(1, len(group))}


def test_odd_spellings(spark):
    rows = [
        (1, "x", '\n\t[{"a": "caf\\u00e9 x"}]'), (2, "x", '[{"a":"CAFÉ\nX"}]'), (3, "x", '\ufeff[{"a":"café  x"}]'),
        (4, "x", '{"a":"\\u00e9","a":"b"}'), (5, "x", '{"a":"b","a":"é"}'), (6, "x", '{"n":NaN,"t":"\\u00e9"}'), (7, "x", '{"t":"É","n":NaN}'),
        (8, "x", "[broken"), (9, "x", "broken!"), (10, "x", "{other \\u00e9"),
    ]
    assert {tuple(r) for r in D.superfluous_pairs(table(spark, rows)).collect()} == {(1, 2), (1, 3), (4, 5), (6, 7), (8, 9)}


def test_folding_of_every_letter(spark):
    from pyspark.sql import functions as F

    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalnum()]
    of: dict[bytes, set[str]] = {}
    for r in D.folded(spark.createDataFrame([(c,) for c in every], "c string").withColumn("f", F.regexp_replace("c", r"[^\p{L}\p{N}]+", "")), "f").collect():
        of.setdefault(bare_key(r.c), set()).add(r.f)
    assert all(len(x) == 1 for x in of.values())


def test_hot_group_and_empty(spark, monkeypatch):
    rows = [(i, "train", "Same text %s" % ("." * (i % 3))) for i in range(300)] + [(1000 + i, "test", f"other {i}") for i in range(20)]
    join = D.skew_join
    monkeypatch.setattr(D, "skew_join", lambda a, b, on: join(a, b, on, salts=4, share=0.01, least=10))
    assert {tuple(r) for r in D.superfluous_pairs(table(spark, rows)).collect()} == {(0, i) for i in range(1, 300)}
    assert D.superfluous_pairs(table(spark, rows).limit(0)).count() == 0
    assert D.distinct_records(table(spark, rows).limit(0)).count() == 0


def brute(rows, share=0.9):
    w = {i: words(c) for i, _, c in rows if c is not None}
    out = set()
    for (i, a, c), (j, b, e) in itertools.combinations(rows, 2):
        if {a, b} not in ({"train", "test"}, {"train", "validation"}) or c is None or e is None or not w[i] or not w[j]:
            continue
        x, y = w[i], w[j]
        row = [0] * (len(y) + 1)
        for u in x:
            last, row = row, [0]
            for k, v in enumerate(y):
                row.append(last[k] + 1 if u == v else max(row[-1], last[k + 1]))
        if row[-1] >= share * max(len(x), len(y)) - 1e-9:
            out.add((min(i, j), max(i, j)))
    return out


def test_cross_split_against_brute_force(spark):
    rng = random.Random(2)
    small = [f"w{k}" for k in range(12)]
    rows, i = [], 0
    for _ in range(12):
        n = rng.randrange(1, 60)
        base = [rng.choice(small) if rng.random() < 0.8 else f"r{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(5):
            x = list(base)
            for _ in range(rng.choice((0, 0, 1, n // 11, n // 10, n // 9, n // 5))):
                at = rng.randrange(len(x) + 1)
                rng.choice((lambda: x.insert(at, rng.choice(small)), lambda: x and x.pop(min(at, len(x) - 1)), lambda: x.__setitem__(min(at, len(x) - 1), "z") if x else None))()
            rows.append((i := i + 1, rng.choice(("train", "train", "test", "validation", "other")), " ".join(x)))
    rows += [(900, "train", None), (901, "test", None), (902, "train", ""), (903, "test", "..."), (904, "train", "表单 队列"), (905, "test", "表单队列"), (906, "train", "one"), (907, "test", "ONE!")]
    got = [tuple(r) for r in C.cross_split_pairs(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    partners = Counter(x for pair in got for x in pair)
    classes = C.cross_split_classes(table(spark, rows)).collect()
    assert len(classes) == len(partners) and {r.item_id: r.n_links for r in classes} == partners
    text = {i: tuple(words(c)) for i, _, c in rows if c is not None}
    assert all(text[r.class_id] == text[r.item_id] for r in classes)


def test_cross_split_hot_class(spark, monkeypatch):
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(i, "train" if i % 2 else "test", text if i % 3 else text.upper()) for i in range(60)] + [(500, "train", text + " more")]
    join = C.skew_join
    monkeypatch.setattr(C, "skew_join", lambda a, b, on: join(a, b, on, salts=3, share=0.01, least=5))
    monkeypatch.setattr(C, "HOT", 0.0)
    want = {(min(a, b), max(a, b)) for a in range(0, 60, 2) for b in range(1, 60, 2)} | {(a, 500) for a in range(0, 60, 2)}
    assert {tuple(r) for r in C.cross_split_pairs(table(spark, rows)).collect()} == want
    assert C.cross_split_pairs(table(spark, rows).limit(0)).count() == 0
    report = C.overlap_report(table(spark, rows)).collect()
    assert [(r.source_split, r.n_records, r.n_overlapping, r.n_pairs) for r in report] == [("test", 30, 30, len(want))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        last, row = row, [0]
        for k, v in enumerate(b):
            row.append(last[k] + 1 if u == v else max(row[-1], last[k + 1]))
    assert C.common_in_order(np.array(a, np.uint32), np.array(b, np.uint32)) == row[-1]


@pytest.mark.parametrize("a, b, same", [('{"a":1,"b":"x"}', '{"b": "X", "a": 1}', True), ('[{"r":"u"},{"r":"v"}]', '[{"r":"v"},{"r":"u"}]', False), ('{"a":"é"}', '{"a":"\\u00c9"}', True), ('{"a":1}', '{"a":1.0}', False), ("a-b", "A b", True), ('{"a":1,"a":2}', '{"a":2,"a":1}', True), ("[" * 5000, "[" * 5000, True)])
def test_bare_key(a, b, same):
    assert (bare_key(a) == bare_key(b)) is same

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritrace.functions import codec

GOLDEN = [
    ("<analysis>a</analysis><label>safe</label>", "safe", None),
    ("<analysis>\na\n</analysis>\n<label>unsafe</label>\n", "unsafe", None),
    ("<analysis>a</analysis><label> Unsafe </label>", "unsafe", "noncanonical_sections"),
    ("<analysis>a</analysis><label>1</label>", "unsafe", "noncanonical_sections"),
    ("<label>safe</label> ... <label>unsafe</label>", "unsafe", "noncanonical_sections"),
    ("<analysis></analysis><label>safe</label>", "safe", "empty_analysis"),
    ("<analysis>a</analysis></analysis><label>safe</label>", "safe", "nested_output_section"),
    ("<analysis>a<Label>b</analysis><label>safe</label>", "safe", "nested_output_section"),
    ("<analysis>a</analysis><label>safe</label> tail", "safe", "noncanonical_sections"),
    ("<ANALYSIS>a</ANALYSIS><LABEL>safe</LABEL>", "safe", "noncanonical_sections"),
    ("Safety: Controversial", "unsafe", "noncanonical_sections"),
    ("Safety : Safe\nSafety: Unsafe", "unsafe", "noncanonical_sections"),
    ("verdict\n  unsafe \n", "unsafe", "noncanonical_sections"),
    ("it is unsafe", None, "noncanonical_sections"),
    ("unsafe", "unsafe", "noncanonical_sections"),
    ("safe\nmore text", None, "noncanonical_sections"),
    ("<label>maybe</label>", None, "noncanonical_sections"),
    ("<label>maybe</label>\nsafe", "safe", "noncanonical_sections"),
    ("", None, "noncanonical_sections"),
    (None, None, "response_not_string"),
]


def test_golden(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "i int, t string")
    out = df.select("i", codec.parsed_label(F.col("t")).alias("p"), codec.strict_response(F.col("t"))["error"].alias("e")).orderBy("i").collect()
    assert [(r.p, r.e) for r in out] == [(p, e) for _, p, e in GOLDEN]
    assert codec.strict_response is not None
    free = df.select(codec.strict_response(F.col("t"), empty_ok=True)["valid"].alias("v")).collect()
    assert free[5].v and not free[6].v


def test_target(spark):
    row = spark.createDataFrame([("a  b\n<label>x</label>", 1, 2)], "r string, l int, bad int").select(codec.target_text(F.col("r"), F.col("l")).alias("t"), codec.target_text(F.col("r"), F.col("bad")).alias("b")).first()
    assert row.t == "<analysis>\na b \\u003clabel>x\\u003c/label>\n</analysis>\n<label>unsafe</label>"
    assert row.b is None


@pytest.mark.parametrize(
    "prompt, want",
    [
        ("x <untrusted_trajectory>\n a </untrusted_trajectory> b </untrusted_trajectory> c", "a </untrusted_trajectory> b"),
        ("x <untrusted_trajectory> rest ", "rest"),
        ("  no marker ", "no marker"),
        ("<untrusted_trajectory></untrusted_trajectory>", ""),
        (None, ""),
    ],
)
def test_trajectory(spark, prompt, want):
    assert spark.createDataFrame([(prompt,)], "p string").select(codec.trajectory_of(F.col("p")).alias("t")).first().t == want


def test_bounds(spark):
    assert spark.createDataFrame([("</UNTRUSTED_Trajectory>",)], "x string").select(codec.neutral_bounds(F.col("x")).alias("t")).first().t == "\\u003c/UNTRUSTED_Trajectory>"


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=5), c, max_size=3), max_leaves=8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(values, min_size=1, max_size=20))
def test_exact_json(spark, many):
    rows = [(json.dumps(v, indent=1),) for v in many]
    got = [r.j for r in spark.createDataFrame(rows, "x string").select(codec.exact_json("x").alias("j")).collect()]
    assert got == [json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for v in many]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=30), st.integers(0, 1)), min_size=1, max_size=30))
def test_round_trip(spark, many):
    df = spark.createDataFrame([(r.replace("\x00", "") + " <label>safe</label>", y) for r, y in many], "r string, y int")
    out = df.select("y", codec.parsed_label(codec.target_text(F.col("r"), F.col("y")), fallback=False).alias("l")).collect()
    assert all(r.l == ("unsafe" if r.y else "safe") for r in out)


def test_white_space_as_python(spark):
    texts = [" a b ", "\x1ca\x1f", "a  b", "\ta\n", ""]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(codec.collapsed(F.col("t")).alias("c"), codec.trimmed(F.col("t")).alias("s")).collect()
    assert [r.c for r in out] == [" ".join(t.split()) for t in texts]
    assert [r.s for r in out] == [t.strip() for t in texts]

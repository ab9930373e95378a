"""Column builders for verdict texts, prompts and hashes.

All are built-in expressions, so that they stay inside code generation; only exact_json is a Python function.
Patterns are the registry of SURVEY 2.0. White space is what Python's str.split() takes for it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of verdict texts.
TAG = r"(?i)<label>\s*(safe|unsafe|0|1)\s*</label>"
ANALYSIS = r"(?is)<analysis>\s*(.*?)\s*</analysis>"
NATIVE = r"(?i)\bSafety\s*:\s*(Safe|Unsafe|Controversial)\b"
BARE = r"(?i)(?:^|\n)\s*(unsafe|safe)\s*$"
STRUCT = r"(?i)<(/?(?:analysis|label)>)"
BOUND = r"(?i)<(/?untrusted_trajectory>)"
CANON = r"(?s)\A\s*<analysis>\s*(.*?)\s*</analysis>\s*<label>(safe|unsafe)</label>\s*\z"
WS = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]+"
#: The same characters, to trim by.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
OPEN, CLOSE = "<untrusted_trajectory>", "</untrusted_trajectory>"
TARGET_TAGS = ("<analysis>", "</analysis>", "<label>", "</label>")
INVALID = "__invalid__"


def trimmed(c: Column) -> Column:
    """Without white space at both ends, as Python strips it."""
    return F.btrim(c, F.lit(BLANKS))


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, WS, " "))


def last_match(c: Column, pattern: str) -> Column:
    """Group 1 of the last match, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def label_text(c: Column) -> Column:
    """safe or unsafe from the spellings that outputs use; null for anything else."""
    x = F.lower(trimmed(c))
    return F.when(x.isin("unsafe", "1", "controversial"), "unsafe").when(x.isin("safe", "0"), "safe")


def label_int(c: Column) -> Column:
    return F.when(c == "unsafe", 1).when(c == "safe", 0)


def label_of_int(c: Column) -> Column:
    return F.when(c == 1, "unsafe").when(c == 0, "safe")


def reward_label(c: Column) -> Column:
    """A target's label of rewards, which know two: unsafe or 1, safe or 0, in any case; null for anything else, also the texts true and false.

    A boolean column counts as 1 and 0.
    """
    x = F.lower(trimmed(c.cast("string")))
    boolean = F.typeof(c) == "boolean"
    return F.when(x.isin("unsafe", "1") | (boolean & (x == "true")), "unsafe").when(x.isin("safe", "0") | (boolean & (x == "false")), "safe")


def parsed_label(c: Column, fallback: bool = True) -> Column:
    """The last tagged label; else, with fallback, the last native verdict, else a bare last line."""
    tag = label_text(last_match(c, TAG))
    return F.coalesce(tag, label_text(last_match(c, NATIVE)), label_text(last_match(c, BARE))) if fallback else tag


def parsed_analysis(c: Column) -> Column:
    """The last analysis section, trimmed; null if there is none or it is empty."""
    return F.nullif(trimmed(last_match(c, ANALYSIS)), F.lit(""))


def strict_response(c: Column, empty_ok: bool = False) -> Column:
    """struct(valid, analysis, label, error) of a response in exactly the canonical shape.

    Errors, in this order: response_not_string (null), noncanonical_sections, empty_analysis (unless empty_ok),
    nested_output_section.
    """
    analysis = trimmed(F.regexp_extract(c, CANON, 1))
    label = F.regexp_extract(c, CANON, 2)  # '' where the shape is another one
    nested = F.lower(analysis).rlike("</?(?:analysis|label)>")
    error = F.when(c.isNull(), "response_not_string").when(label == "", "noncanonical_sections")
    if not empty_ok:
        error = error.when(analysis == "", "empty_analysis")
    error = error.when(nested, "nested_output_section")
    valid = error.isNull()
    return F.struct(valid.alias("valid"), F.when(valid, analysis).alias("analysis"), F.when(valid, label).alias("label"), error.alias("error"))


def neutral_tags(c: Column) -> Column:
    """Section tags inside a rationale, made harmless."""
    return F.regexp_replace(c, STRUCT, "\\\\u003c$1")


def neutral_bounds(c: Column) -> Column:
    """Trajectory markers inside a trajectory, made harmless."""
    return F.regexp_replace(c, BOUND, "\\\\u003c$1")


def target_text(reason: Column, label: Column) -> Column:
    """The two tagged sections that a model is trained to answer; null if the label isn't known."""
    return F.concat(F.lit("<analysis>\n"), neutral_tags(collapsed(reason)), F.lit("\n</analysis>\n<label>"), label_text(label.cast("string")), F.lit("</label>"))


def canonical_response(analysis: Column, label: Column) -> Column:
    """As target_text, of an analysis that is kept as it is; null for an empty one."""
    a = F.nullif(trimmed(analysis), F.lit(""))
    return F.concat(F.lit("<analysis>\n"), a, F.lit("\n</analysis>\n<label>"), label_text(label), F.lit("</label>"))


def native_json(c: Column) -> Column:
    """JSON text with its fields in order and no blanks, in the JVM; a text that isn't JSON comes out as a JSON string.

    Integers, strings without control characters and fields of the basic plane come out as exact_json has them; other numbers
    may be spelled otherwise.
    """
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.to_json(F.to_variant_object(F.array(c))))


@F.pandas_udf(T.StringType())
def exact_json(c: pd.Series) -> pd.Series:
    """JSON text with sorted fields, no blanks, no escapes beyond the needed; texts that aren't JSON as JSON strings."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            value = json.loads(x)
        except ValueError:
            value = x
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return c.map(one)


def content_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def user_prompt(instruction: tuple[str, ...], trajectory: Column) -> Column:
    """Instruction lines, a blank line and the trajectory between its markers."""
    return F.concat_ws("\n", *[F.lit(x) for x in instruction], F.lit(""), F.lit(OPEN), neutral_bounds(trajectory), F.lit(CLOSE))


def messages(system: str, user: Column, answer: Column | None = None) -> Column:
    """Chat messages: system, user and, for training, assistant."""
    rows = [("system", F.lit(system)), ("user", user)] + ([("assistant", answer)] if answer is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in rows])


def rendered(messages: Column, opening: str = "<|{role}|>\n", closing: str = "\n", answer: str = "<|assistant|>\n") -> Column:
    """A chat as one text: each message between opening and closing, and what the answer begins with. Other templates are other columns.

    {role} stands for the message's role; null contents count as empty, a null list gives null.
    """
    before, _, after = opening.partition("{role}")
    one = lambda m: F.concat(F.lit(before), m["role"], F.lit(after), F.coalesce(m["content"], F.lit("")), F.lit(closing))
    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit(answer))


def register_functions(spark: SparkSession) -> None:
    """SQL functions for sessions of the caller: strict_label(response) and strict_reward(response, target), both built-in expressions."""
    quoted = CANON.replace("'", "\\'")
    nested = "lower(trim(regexp_extract(response, r'%s', 1))) rlike '</?(?:analysis|label)>'" % quoted
    label = f"case when regexp_extract(response, r'{quoted}', 2) <> '' and trim(regexp_extract(response, r'{quoted}', 1)) <> '' and not {nested} then regexp_extract(response, r'{quoted}', 2) end"
    spark.sql(f"create or replace temporary function strict_label(response string) returns string return {label}")
    spark.sql("create or replace temporary function strict_reward(response string, target string) returns double return case when target not in ('safe', 'unsafe') or target is null then null when strict_label(response) is null then -1.25D when strict_label(response) = target then 1D else -1D end")


def trajectory_of(prompt: Column) -> Column:
    """What stands between the first open marker and the last close marker after it.

    Without a close marker the rest, without an open one all of it; trimmed; '' for null.
    """
    at = F.instr(prompt, OPEN)
    rest = F.substr(prompt, at + F.lit(len(OPEN)))
    end = F.length(rest) - F.length(F.substring_index(rest, CLOSE, -1)) - F.lit(len(CLOSE))
    body = F.when(F.instr(rest, CLOSE) > 0, F.substr(rest, F.lit(1), end)).otherwise(rest)
    return F.coalesce(trimmed(F.when(at > 0, body).otherwise(prompt)), F.lit(""))


def fingerprint(spec: Column) -> Column:
    """First 16 digits of the hash of a specification."""
    return F.substring(F.sha2(spec, 256), 1, 16)

"""Prompts cut to a token budget, for any tokenizer that counts the tokens of a chat."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<messages array<struct<role string, content string>>, original_tokens int, final_tokens int, truncated boolean, error string>"


def words_counter(messages: list[dict]) -> int:
    """The default count: blank-separated words of roles and contents."""
    return sum(1 + len((m["content"] or "").split()) for m in messages)


def right_truncated(messages: Column, budget: int, count: Callable[[list[dict]], int] = words_counter) -> Column:
    """The messages with the last user message cut at its right to the longest prefix that fits the budget.

    error (and the messages as they were) for a null list, one without a user message, or when the rest alone is too long.
    Null contents count as empty. The prefix is found by bisection, so count must not fall as text is added.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")

    @F.pandas_udf(RESULT)
    def cut(rows: pd.Series) -> pd.DataFrame:
        out = []
        for row in rows:
            if row is None:
                out.append((None, None, None, None, "not_a_list"))
                continue
            chat = [{"role": m["role"], "content": m["content"] or ""} for m in row]
            size = count(chat)
            users = [k for k, m in enumerate(chat) if m["role"] == "user"]
            if size <= budget:
                out.append((chat, size, size, False, None))
                continue
            if not users:
                out.append((chat, size, size, False, "no_user_message"))
                continue
            text = chat[users[-1]]["content"]
            fits = lambda n: count([*chat[: users[-1]], {"role": "user", "content": text[:n]}, *chat[users[-1] + 1 :]]) <= budget  # noqa: E731, B023
            if not fits(0):
                out.append((chat, size, size, False, "fixed_part_too_long"))
                continue
            low, high = 0, len(text)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if fits(mid) else (low, mid - 1)
            chat[users[-1]]["content"] = text[:low]
            out.append((chat, size, count(chat), True, None))
        return pd.DataFrame(out, columns=["messages", "original_tokens", "final_tokens", "truncated", "error"])

    return cut(messages)


def truncated_chars(messages: Column, budget: int) -> Column:
    """The last user message cut so that all contents have at most budget characters: the closed form of an additive count."""
    at = F.size(messages) - F.array_position(F.transform(F.reverse(messages), lambda m: m["role"] == "user"), True).cast("int")
    total = F.aggregate(messages, F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    text = F.coalesce(F.try_element_at(messages, at + 1)["content"], F.lit(""))
    keep = F.greatest(F.length(text) - F.greatest(total - budget, F.lit(0)), F.lit(0))
    return F.struct(total.alias("original"), (total > budget).alias("truncated"), F.substr(text, F.lit(1), keep).alias("last_user"))


def with_truncation(items: DataFrame, budget: int, count: Callable[[list[dict]], int] = words_counter, col: str = "messages") -> DataFrame:
    """Adds the prompt_ columns that a loader wants: original and visible tokens and whether it was cut."""
    t = items.withColumn("_t", right_truncated(F.col(col), budget, count))
    return t.select(
        *[c for c in items.columns if c != col], F.col("_t.messages").alias(col), F.col("_t.original_tokens").alias("prompt_original_tokens"),
        F.col("_t.final_tokens").alias("prompt_visible_tokens"), F.col("_t.truncated").alias("prompt_right_truncated"), F.col("_t.error").alias("prompt_error"),
    )

"""Oversized items in pieces: lexical-cohesion segmentation under a size limit, with an exact overlap.

Only the items over their source's limit leave the JVM. Their text is the contents of their messages put together. Natural
gaps are, from strong to weak, between messages or events, paragraphs, sentences and words (a Han character is a word).
At every gap of sentence strength or more the words of the blocks on both sides are compared; where the similarity has
a valley the subject changes. Within each size window the deepest valley is taken (of equal depth the stronger gap, then the
later one), without such a gap the last one between words. They are looked for in the last part of the window; if it has
none, the last gap before it is taken (one between words only without a stronger one), so that the piece is as long as it
can be. The limit itself is the cut only where the whole window has no gap. The next piece starts `overlap` characters
before the cut, so that pieces put together without their overlaps are the text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.llm.records import HAN
from veritrace.operators.skew import semi_checked
from veritrace.runtime import materialize

EVENT, PARAGRAPH, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0
NAMES = {EVENT: "event", PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", NONE: "none"}
_EVENT = re.compile(r"\}\s*,\s*(?=\{)")
_PARAGRAPH = re.compile(r"\n\s*\n|\n")
_SENTENCE = re.compile(r"[.!?…]+[\"'”»)\]]*\s+|[。！？]+[”»）]*")
_GAP = re.compile(f"\\s+|(?<=[{HAN}])(?=[{HAN}])")
_TOKEN = re.compile(f"[{HAN}]|[^\\W\\d_{HAN}]+")
#: Units (the text between two gaps) in a block on each side of a gap.
BLOCK = 6
#: A piece is cut in the last part of its window, from this share of the limit on, if there is a gap.
FILL = 0.5


def natural_gaps(text: str, joints: list[int]) -> dict[int, int]:
    """Place -> strength of the gaps of sentence strength or more; joints are places between messages."""
    gaps: dict[int, int] = {}
    for strength, pattern in ((SENTENCE, _SENTENCE), (PARAGRAPH, _PARAGRAPH), (EVENT, _EVENT)):
        for m in pattern.finditer(text):
            gaps[m.end()] = strength
    gaps.update((j, EVENT) for j in joints)
    return {p: s for p, s in gaps.items() if 0 < p < len(text)}


def depths(text: str, places: list[int], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at each gap: how far the cosine of its two blocks lies below the peaks around it."""
    cuts = [0, *places, len(text)]
    bags = [Counter(w.casefold() for w in _TOKEN.findall(text, a, b)) for a, b in zip(cuts, cuts[1:])]
    # sums that follow the blocks: the scalar product and both squared lengths change only by the words that come and go
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = left2 = right2 = 0
    for bag in bags[:block]:
        for w, n in bag.items():
            have = right.get(w, 0)
            right2 += n * (2 * have + n)
            right[w] = have + n
    scores = []
    for i in range(len(places)):
        # gap i lies between unit i and unit i + 1
        for w, n in bags[i].items():
            a, b = left.get(w, 0), right[w]
            dot += (a + n) * (b - n) - a * b
            left2 += n * (2 * a + n)
            right2 -= n * (2 * b - n)
            left[w], right[w] = a + n, b - n
        if i >= block:
            for w, n in bags[i - block].items():
                a = left[w]
                dot -= n * right.get(w, 0)
                left2 -= n * (2 * a - n)
                left[w] = a - n
        if i + block < len(bags):
            for w, n in bags[i + block].items():
                b = right.get(w, 0)
                dot += n * left.get(w, 0)
                right2 += n * (2 * b + n)
                right[w] = b + n
        norm = sqrt(left2 * right2)
        scores.append(dot / norm if norm else 0.0)
    # the peak on a side is the end of the rise that begins at the gap, so that of the neighbour if it isn't lower
    peaks = [0.0] * len(scores)
    for order in (range(len(scores)), range(len(scores) - 1, -1, -1)):
        last = peak = -1.0
        for i in order:
            peak = peak if last >= scores[i] else scores[i]
            last = scores[i]
            peaks[i] += peak
    return [p - 2 * s for p, s in zip(peaks, scores)]


def pieces(text: str, joints: list[int], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first character, end character, strength of the cut at the end) of each piece; none is longer than limit."""
    if len(text) <= limit:
        return [(0, len(text), NONE)]
    overlap = min(max(overlap, 0), limit - 1)
    gaps = natural_gaps(text, joints)
    places = sorted(gaps)
    depth = depths(text, places)

    def best(low: int, high: int, deepest: bool) -> tuple[int, int] | None:
        a, b = bisect_left(places, low), bisect_right(places, high)
        if a < b:
            i = max(range(a, b), key=lambda i: (round(depth[i], 9), gaps[places[i]], i)) if deepest else b - 1
            return places[i], gaps[places[i]]
        ends = [m.end() for m in _GAP.finditer(text, max(low - 1, 0), min(high + 1, len(text))) if low <= m.end() <= high]
        return (ends[-1], WORD) if ends else None

    out, start = [], 0
    while len(text) - start > limit:
        # a piece has to go beyond the overlap, else the next one wouldn't begin later
        least, high = start + overlap + 1, start + limit
        low = max(least, start + int(limit * FILL))
        cut, strength = best(low, high, True) or best(least, low - 1, False) or (high, NONE)
        out.append((start, cut, strength))
        start = cut - overlap
    return [*out, (start, len(text), NONE)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, contents, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
            joints, at = [], 0
            for c in contents:
                at += len(c)
                joints.append(at)
            text = "".join(contents)
            found = pieces(text, joints, limit, overlap)
            for k, (a, b, s) in enumerate(found):
                rows.append((i, k, len(found), a, b, found[k - 1][1] - a if k else 0, NAMES[s] if k + 1 < len(found) else "end", text[a:b]))
        cols = list(zip(*rows)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["rl_id", "piece", "n_pieces", "first_char", "end_char", "overlap", "cut_at", "text"])


def size_of(messages: Column) -> Column:
    """Characters (code points) of all contents together; a null content, message or list counts 0."""
    return F.coalesce(F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0))), F.lit(0))


def _limits(limits: DataFrame) -> DataFrame:
    """One row a source: the smallest usable limit, with the overlap stated with it."""
    return (
        limits.filter("max_chars >= 1 and source is not null")
        .groupBy(F.trim("source").alias("source"))
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("l"))
        .select("source", "l.max_chars", "l.overlap_chars")
    )


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(rl_id, piece, n_pieces, first_char, end_char, overlap, cut_at, text) of each item over its source's limit.

    items: rl_id, source, messages; limits: source, max_chars, overlap_chars; other columns are ignored. An item whose source
    has no limit of one or more characters isn't split. Null and negative overlaps count 0, one of the limit or more
    is the limit less one. Rows of an item that say the same come out once; rows of one id that differ are cut each by itself.
    Empty tables give no rows.
    """
    rows = items.select("rl_id", F.trim("source").alias("source"), "messages").filter("rl_id is not null")
    contents = F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))).alias("contents")
    over = rows.join(_limits(limits), "source").filter(size_of(F.col("messages")) > F.col("max_chars")).select("rl_id", contents, "max_chars", "overlap_chars")
    shape = "rl_id long, piece int, n_pieces int, first_char int, end_char int, overlap int, cut_at string, text string"
    # only ids are shuffled: of ids that come once every row is cut where it is; the rows of the others are made one a text
    twice = items.groupBy("rl_id").count().filter("count > 1 and rl_id is not null").select("rl_id")
    if twice.limit(1).count():
        twice = materialize(twice, "split-repeated")
        single = semi_checked(over, twice, "rl_id", how="left_anti")
        over = single.unionByName(semi_checked(over, twice, "rl_id").dropDuplicates(["rl_id", "contents"]))
    return over.mapInArrow(_cut, shape)


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """rl_id of each item that had to be split."""
    return split_items(items, limits).filter("n_pieces > 1").select("rl_id").distinct()


def split_report(items: DataFrame, limits: DataFrame, measured: DataFrame) -> DataFrame:
    """Per source: items, items split, pieces, the natural cuts among the cuts, and what the token measurements hint.

    measured (rl_id, original_tokens, truncated) may repeat, contradict or lack items; of an item the largest count and
    any true flag are taken. It doesn't decide anything.
    """
    cut = split_items(items, limits).groupBy("rl_id").agg(F.count("*").alias("pieces"), F.count_if(F.col("cut_at").isin("event", "paragraph", "sentence")).alias("natural"), F.count_if(F.col("cut_at") != "end").alias("cuts"))
    hint = measured.groupBy("rl_id").agg(F.max("original_tokens").alias("tokens"), F.bool_or("truncated").alias("flag"))
    own = items.select("rl_id", F.trim("source").alias("source")).dropDuplicates(["rl_id"])
    return (
        own.join(cut, "rl_id", "left").join(hint, "rl_id", "left").groupBy("source").agg(
            F.count("*").alias("n_items"),
            F.count("pieces").alias("n_split"),
            F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"),
            F.coalesce(F.sum("cuts"), F.lit(0)).alias("n_cuts"),
            F.coalesce(F.sum("natural"), F.lit(0)).alias("n_natural_cuts"),
            F.count_if(F.col("flag") & F.col("pieces").isNull()).alias("n_flagged_not_split"),
            F.max("tokens").alias("max_tokens"),
        )
    )

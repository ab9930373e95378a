"""Held-out passages in training text: one Aho-Corasick automaton over normalised passages, one scan of each text.

Text is normalised to its words: maximal runs of letters or digits, case-folded. A passage leaks into a document if a
run of at least `least` of its words stands there consecutively. The automaton holds every window of `least` words of
every passage, as sequences of word numbers; a document is turned into word numbers (words of no passage are number 0,
which ends every match), scanned once, and windows that follow one another in the document and in the passage are
joined into spans, which are mapped to character offsets of the original text.

Passages are the side that is held in memory: they are taken in blocks of at most BLOCK_WORDS words, so memory has a bound
whatever their number. Each worker process builds the automaton of a block once and keeps it between its tasks. Where there is more
than one block, the documents aren't scanned once for each: windows of both sides are first joined by their 64-bit
fingerprints, one pass over the documents, and only a document that shares a fingerprint with a block is scanned with its automaton.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.operators.skew import semi_checked
from veritrace.runtime import materialize

_WORD = re.compile(r"[^\W_]+")
LEAST = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of passages in one automaton; about 900 bytes each in a worker if no windows are equal, so 180 MB, and 12 s to build.
BLOCK_WORDS = 200_000


class Matcher:
    """An automaton over the word windows of some passages."""

    def __init__(self, passages: list[tuple[int, str]], least: int = LEAST) -> None:
        import ahocorasick

        self.least = least
        self.numbers: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        windows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in passages:
            seq = [self.numbers.setdefault(w.casefold(), len(self.numbers) + 1) for w in _WORD.findall(text)]
            for i in range(len(seq) - least + 1):
                windows.setdefault(tuple(seq[i : i + least]), []).append((item, i))
        for key, places in windows.items():
            self.automaton.add_word(key, places)
        self.empty = not windows
        if not self.empty:
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, first character, end character, words) of each maximal run; several of one item where it recurs."""
        if self.empty:
            return []
        get, least = self.numbers.get, self.least
        seq = [get(w, 0) for w in map(str.casefold, _WORD.findall(text))]
        open_runs: dict[tuple[int, int], list[int]] = {}
        runs: list[tuple[int, int, int]] = []
        # only stretches of known words can match
        start, n = 0, len(seq)
        while start < n:
            try:
                stop = seq.index(0, start)
            except ValueError:
                stop = n
            if stop - start >= least:
                for end, places in self.automaton.iter(tuple(seq[start:stop])):
                    first = start + end - least + 1
                    for item, at in places:
                        run = open_runs.get((item, first - at))
                        if run and run[1] == first + least - 1:
                            run[1] += 1
                        else:
                            if run:
                                runs.append((item, *run))
                            open_runs[item, first - at] = [first, first + least]
            start = stop + 1
        runs += [(item, *run) for (item, _), run in open_runs.items()]
        if not runs:
            return []
        where = [m.span() for m in _WORD.finditer(text)]
        return sorted((item, where[a][0], where[b - 1][1], b - a) for item, a, b in runs)


_KEPT: dict[str, Matcher] = {}


def _matcher(key: str, passages, least: int) -> Matcher:
    """One for each worker process, kept between the partitions that it takes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Matcher(passages.value, least)
    return _KEPT[key]


def _scan(passages, least: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher = _matcher(key, passages, least)
            ids, found = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = matcher.spans(text)
                ids += [i] * len(spans)
                found += spans
            cols = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["doc_id", "item_id", "first_char", "end_char", "words"],
            )

    return run


def fingerprints(text: str, least: int) -> np.ndarray:
    """Distinct 64-bit hashes of the windows of `least` words: a polynomial of the words' hashes, modulo 2^64."""
    words = [xxhash.xxh3_64_intdigest(w.casefold()) for w in _WORD.findall(text)]
    if len(words) < least:
        return np.zeros(0, np.int64)
    h = np.array(words, np.uint64)
    out = np.zeros(len(h) - least + 1, np.uint64)
    for k in range(least):
        out = out * _BASE + h[k : k + len(out)]
    return np.unique(out.view(np.int64))


def _fingerprinted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(t, least) for t in batch.column(1).to_pylist()]
            sizes = [len(f) for f in found]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["id", "f"])

    return run


def _blocks(passages: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, block) of the distinct passages as a written table, and the number of blocks.

    Blocks come from running sums of words, taken in cells of a hash and over their totals: a passage is in the block in which
    its words begin. A block is as large as BLOCK_WORDS and the words of its longest passage together at most.
    """
    words = F.size(F.split("text", r"[^\p{L}\p{N}]+")).cast("long")
    rows = passages.select("item_id", "text").filter("text is not null and item_id is not null").distinct().withColumn("n", words)
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total <= BLOCK_WORDS:
        return rows.select("item_id", "text", F.lit(0).alias("block")), 1
    rows = materialize(rows.withColumn("cell", F.pmod(F.xxhash64("item_id", "text"), F.lit(1024))), "leak-passages")
    sums = rows.groupBy("cell").agg(F.sum("n").alias("s"))
    base = sums.select("cell", (F.sum("s").over(Window.orderBy("cell")) - F.col("s")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = rows.withColumn("at", inside).join(F.broadcast(base), "cell").select("item_id", "text", F.floor((F.col("at") + F.col("base")) / BLOCK_WORDS).cast("int").alias("block"))
    return materialize(placed, "leak-blocks"), total // BLOCK_WORDS + 1


def leaked_spans(docs: DataFrame, passages: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, first_char, end_char, words): each maximal run of at least `least` words that both have.

    docs: doc_id, text; passages: item_id, text; other columns are ignored. Null texts on either side, and passages of
    fewer words, match nothing. Rows that repeat a doc_id with the same text count once in leaked_pairs, each here.
    Offsets are code points of the original text. Empty tables give no rows.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", "text").filter("text is not null")
    placed, n = _blocks(passages)
    if n > 1:
        shape = "id long, f long"
        keys = materialize(placed.select(F.col("block").cast("long").alias("id"), "text").mapInArrow(_fingerprinted(least), shape).select(F.col("id").alias("block"), "f").distinct(), "leak-fingerprints")
        found = rows.select(F.col("doc_id").alias("id"), "text").mapInArrow(_fingerprinted(least), shape)
        hits = materialize(found.join(keys, "f").select(F.col("id").alias("doc_id"), "block").distinct(), "leak-hits")
        affected = materialize(hits.select("doc_id").distinct(), "leak-affected")
        rows = materialize(semi_checked(rows, affected, "doc_id"), "leak-documents")
    out = None
    for block in range(n):
        held = [(r.item_id, r.text) for r in placed.filter(F.col("block") == block).select("item_id", "text").collect()]
        some = rows if n == 1 else rows.join(hits.filter(F.col("block") == block).select("doc_id"), "doc_id", "left_semi")
        part = some.mapInArrow(_scan(sc.broadcast(held), least, uuid.uuid4().hex), "doc_id long, item_id long, first_char int, end_char int, words int")
        out = part if out is None else out.unionByName(part)
    return out


def leaked_pairs(docs: DataFrame, passages: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id): each document and each passage that leaked into it."""
    return leaked_spans(docs, passages, least).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, passages: DataFrame, least: int = LEAST) -> DataFrame:
    """Of every passage: documents that hold it, longest run in words, its words, and whether it leaked wholly."""
    spans = leaked_spans(docs, passages, least)
    size = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    found = spans.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("words").alias("longest"))
    own = passages.select("item_id", F.coalesce(size, F.lit(0)).alias("n_words")).dropDuplicates(["item_id"])
    return own.join(found, "item_id", "left").select(
        "item_id", "n_words", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce(F.col("longest") >= F.col("n_words"), F.lit(False)).alias("whole")
    )

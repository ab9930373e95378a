"""Records of held-out splits that are also in the training split, exactly or nearly: an exact prefix-filter join.

Two records match if their longest common subsequence of words is at least `share` of the longer one. With width-w
shingles, L common words in order and n, m words leave at least L - (w-1)(n + m - 2L + 1) shingles in common, so for
w = 1 the bound is L itself. Five words and 0.8 would miss matches at nine words of ten (they share as little as half of
their five-word shingles), which is why the width here is one word, counted with its occurrence number, so that
repeated words give rare shingles too.

Prefix filter. Order all shingles from rare to common, by any order that both sides share. Of the words that a match
aligns, take the HITS rarest: before them a record has at most n - L words that aren't aligned, so all HITS lie within
its first n - L + HITS shingles, in both records. Word filter: an aligned word stands at places that differ by at most
max(n, m) - L, which can be tested where the word occurs once in both. Length filter: min(n, m) >= L. Count filter: words put
into CELLS cells by hash give counts that differ by at most n + m - 2L in all, so a coincidence of common shingles
(texts in Han script have few rare words) is dropped where it arises. A pair without HITS shingles that pass can't match.

Steps: (1) words are hashed once and written, 4 bytes a word; (2) records with the same words form a class, and one
representative of each goes on; (3) rarity is read off a sketch of fixed size, counted over all representatives;
(4) held-out prefixes are the index, training prefixes probe it; (5) the words of each candidate pair are compared in
full; (6) classes are opened again into records.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrace.llm.records import words
from veritrace.operators.skew import semi_checked, skew_join
from veritrace.runtime import materialize

#: Buckets of the rarity sketch; what the driver holds and broadcasts is one byte for each.
SKETCH = 1 << 18
SHARE = 0.9
#: Prefix shingles that a candidate pair must have in common; more of them mean longer prefixes and fewer candidates.
HITS = 8
#: Cells of the word counts that go with each prefix shingle, a byte each (larger counts are 255), eight to a long.
CELLS = 16
#: Cells of the counts that candidate pairs are compared by before their words are fetched.
FINE = 512
#: A shingle is hot if it is in more than this share of the records; its training rows are spread over SALTS tasks.
HOT = 0.02
SALTS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xBF58476D1CE4E5B9)


def hashed_words(text: str, cache: dict[str, int]) -> np.ndarray:
    out = []
    for w in words(text):
        h = cache.get(w)
        if h is None:
            if len(cache) > 400_000:
                cache.clear()
            cache[w] = h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(h)
    return np.array(out, dtype=np.uint32)


def _sequences(batches):
    cache: dict[str, int] = {}
    for batch in batches:
        seqs = [hashed_words(t, cache) for t in batch.column(2).to_pylist()]
        k1, k2 = [], []
        for s in seqs:
            v = s.astype(np.uint64) * _MIX
            at = np.arange(1, len(s) + 1, dtype=np.uint64) * _FOLD
            x = (v ^ (v >> np.uint64(29)) ^ at) * _FOLD
            y = (v ^ (v >> np.uint64(31))) * (at | np.uint64(1))
            k1.append(int((x ^ (x >> np.uint64(32))).sum(dtype=np.uint64).astype(np.int64)))
            k2.append(int((y ^ (y >> np.uint64(30))).sum(dtype=np.uint64).astype(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(s) for s in seqs], pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([s.tobytes() for s in seqs], pa.binary())],
            names=["id", "held", "n", "k1", "k2", "seq"],
        )


def shingles(seq: np.ndarray) -> np.ndarray:
    """One distinct 64-bit element for each word: the word's hash mixed with its occurrence number in the record."""
    return _placed(seq)[0]


def _placed(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles, and the place of each in the record: -1 if its word occurs more than once."""
    if not len(seq):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    order = np.argsort(seq, kind="stable")
    s = seq[order]
    start = np.r_[True, s[1:] != s[:-1]]
    at = np.arange(len(s))
    occurrence = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)
    h = (s.astype(np.uint64) + (occurrence << np.uint64(32))) * _MIX
    h ^= h >> np.uint64(32)
    h *= _FOLD
    single = start & np.r_[start[1:], True]
    return h ^ (h >> np.uint64(29)), np.where(single, order, -1).astype(np.int32)


def _sketch(buckets: int):
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = [shingles(np.frombuffer(raw, np.uint32)) for raw in batch.column(0).to_pylist()]
            if found:
                total += np.bincount((np.concatenate(found) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    return count


def prefix_size(n: int, share: float) -> int:
    return min(n, n - math.ceil(round(share * n, 6)) + HITS)


def cells(seq: np.ndarray) -> np.ndarray:
    """Word counts by cell as CELLS / 8 longs."""
    counts = np.bincount((seq * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).view(np.int64)


def _prefixes(ranks, hot: int, share: float):
    def emit(batches):
        rank = ranks.value
        salts = np.arange(1, SALTS + 1, dtype=np.uint64) * _FOLD
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(4 + CELLS // 8)]
            for i, side, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                seq = np.frombuffer(raw, np.uint32)
                h, place = _placed(seq)
                r = rank[(h % np.uint64(len(rank))).astype(np.int64)]
                order = np.lexsort((h, r))[: prefix_size(len(h), share)]
                e, p, wide = h[order], place[order], r[order] >= hot
                if wide.any() and side == 0:
                    e = np.where(wide, e ^ salts[i % SALTS], e)
                elif wide.any():
                    e = np.r_[e[~wide], (e[wide][:, None] ^ salts).ravel()]
                    p = np.r_[p[~wide], np.repeat(p[wide], SALTS)]
                # place + 1 and number of words in one long: a field of a shuffled row takes 8 bytes whatever it holds
                np_ = (np.int64(len(h)) << np.int64(32)) | (p.astype(np.int64) + 1)
                for part, x in zip(parts, (np.full(len(e), i, np.int64), np.full(len(e), side, np.int8), e.view(np.int64), np_, *(np.full(len(e), c, np.int64) for c in cells(seq)))):
                    part.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=["id", "side", "e", "np", *(f"c{c}" for c in range(CELLS // 8))])

    return emit


def common_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; bit-parallel over the words of a, one big-integer step a word of b."""
    head = 0
    stop = min(len(a), len(b))
    same = a[:stop] == b[:stop]
    head = int(np.argmin(same)) if stop and not same.all() else stop
    a, b = a[head:], b[head:]
    stop = min(len(a), len(b))
    same = a[::-1][:stop] == b[::-1][:stop]
    tail = int(np.argmin(same)) if stop and not same.all() else stop
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = where.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return head + tail + len(a) - v.bit_count()


def agrees(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    need = math.ceil(round(share * max(len(a), len(b)), 6))
    if min(len(a), len(b)) < need:
        return False
    if len(np.intersect1d(shingles(a), shingles(b), assume_unique=True)) < need:
        return False
    return common_in_order(a, b) >= need


def _counted(batches):
    """Adds the word counts in FINE cells, a byte each, to (id, seq)."""
    for batch in batches:
        fine = [np.minimum(np.bincount((np.frombuffer(x, np.uint32) * np.uint32(2654435761)) >> np.uint32(33 - FINE.bit_length()), minlength=FINE), 255).astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary()), batch.column(1)], names=["id", "fine", "seq"])


def _near(share: float):
    """Keeps the pairs whose fine counts allow a match, from (a, b, na, nb, fine of a, fine of b)."""

    def check(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            fa, fb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE).astype(np.int64) for c in (4, 5))
            keep = np.abs(fa - fb).sum(1) <= na + nb - 2 * np.ceil(np.round(share * np.maximum(na, nb), 6))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _verify(share: float):
    def check(batches):
        for batch in batches:
            keep = [agrees(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), share) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def _with_both(pairs: DataFrame, side: DataFrame, col: str) -> DataFrame:
    """pairs (a, b) with column col of the records a and b."""
    one = skew_join(pairs, side.select(F.col("id").alias("a"), F.col(col).alias("ca")), ["a"])
    return one.join(side.select(F.col("id").alias("b"), F.col(col).alias("cb")), "b")


def _linked(items: DataFrame, train: str, held: tuple[str, ...], share: float, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(copies, links) as written tables: copies rep, id, held of every record with its class; links a, b of the representatives of
    a training class and a held-out class that match (the same one if a class is on both sides)."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").alias("id"), F.col("source_split").isin(*held).cast("byte").alias("held"), F.col("content").alias("text")).filter(
        F.col("source_split").isin(train, *held) & F.col("content").isNotNull() & F.col("item_id").isNotNull()
    )
    seqs = materialize(rows.mapInArrow(_sequences, "id long, held byte, n int, k1 long, k2 long, seq binary").filter("n > 0"), "split-words")
    classes = materialize(
        seqs.groupBy("k1", "k2").agg(F.min("id").alias("rep"), (F.min("held") != F.max("held")).alias("mixed")), "split-classes"
    )
    copies = materialize(skew_join(seqs.select("id", "held", "k1", "k2"), classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("rep", "id", "held").distinct(), "split-copies")
    mixed = materialize(classes.filter("mixed").select(F.col("rep").alias("id")), "split-mixed")
    # one representative of each class goes on; a class can be on both sides
    extra = materialize(copies.filter("id <> rep").select("id").distinct(), "split-extra")
    reps = semi_checked(seqs, extra, "id", how="left_anti")
    sketch = reps.select("seq").mapInArrow(_sketch(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    rank = np.zeros(buckets, np.uint8)
    scale = lambda n: np.minimum(255, 6 * np.log2(1 + n)).astype(np.uint8)
    rank[sketch["bucket"].to_numpy()] = scale(sketch["n"].to_numpy())
    hot = int(scale(np.array(HOT * classes.count()))) + 1
    ranks = spark.sparkContext.broadcast(rank)
    longs = [f"c{c}" for c in range(CELLS // 8)]
    shape = "id long, side byte, e long, np long, " + ", ".join(f"{c} long" for c in longs)
    one_side = reps.select("id", "held", "seq")
    other_side = semi_checked(one_side, mixed, "id").withColumn("held", (1 - F.col("held")).cast("byte"))
    entries = materialize(one_side.unionByName(other_side).mapInArrow(_prefixes(ranks, hot, share), shape), "split-prefixes")
    left = entries.filter("side = 0").select("e", F.col("id").alias("a"), F.col("np").alias("npa"), *(F.col(c).alias(c + "a") for c in longs))
    right = entries.filter("side = 1").select("e", F.col("id").alias("b"), F.col("np").alias("npb"), *(F.col(c).alias(c + "b") for c in longs))
    na, nb = F.shiftright("npa", 32), F.shiftright("npb", 32)
    place_a, place_b = F.col("npa").bitwiseAND((1 << 32) - 1), F.col("npb").bitwiseAND((1 << 32) - 1)
    need = F.ceil(F.round(F.lit(share) * F.greatest(na, nb), 6))
    byte = lambda c, i: F.shiftright(c, 8 * i).bitwiseAND(255)
    apart = sum((F.abs(byte(c + "a", i) - byte(c + "b", i)) for c in longs for i in range(8)), F.lit(0))
    found = (
        left.join(right, "e")
        .filter(F.least(na, nb) >= need)
        .filter((place_a == 0) | (place_b == 0) | (F.abs(place_a - place_b) <= F.greatest(na, nb) - need))
        .filter(apart <= na + nb - 2 * need)
        .filter("a <> b")
        .groupBy("a", "b")
        .agg(F.count("*").alias("hits"), F.first(F.least(F.lit(HITS), need)).alias("need"))
        .filter("hits >= need")
        .select("a", "b")
    )
    candidates = materialize(found, "split-candidates")
    ids = materialize(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "split-candidate-ids")
    text = materialize(semi_checked(reps.select("id", "seq"), ids, "id").mapInArrow(_counted, "id long, fine binary, seq binary"), "split-candidate-words")
    size = (F.octet_length("seq") / 4).cast("int").alias("size")
    counted = _with_both(candidates, text.select("id", F.struct(size, "fine").alias("x")), "x").select("a", "b", F.col("ca.size").alias("na"), F.col("cb.size").alias("nb"), F.col("ca.fine").alias("fa"), F.col("cb.fine").alias("fb"))
    near = materialize(counted.mapInArrow(_near(share), "a long, b long"), "split-near")
    open_ids = materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "split-near-ids")
    pairs = _with_both(near, semi_checked(text, open_ids, "id"), "seq").select("a", "b", "ca", "cb").mapInArrow(_verify(share), "a long, b long")
    links = materialize(pairs.unionByName(mixed.select(F.col("id").alias("a"), F.col("id").alias("b"))), "split-links")
    return copies, links


def cross_split_pairs(items: DataFrame, train: str = "train", held: tuple[str, ...] = ("validation", "test"), share: float = SHARE, buckets: int = SKETCH) -> DataFrame:
    """(item_id_a, item_id_b), a < b: each pair of a training record and a held-out record that match.

    items: item_id, source_split, content; other columns are ignored. Null contents and records without a word match
    nothing; splits other than those named take no part; a repeated item_id counts once. Words are compared by 32-bit
    hashes. Empty input gives no rows. The pairs of a class of n training and m held-out copies are n * m; cross_split_classes has the
    same links without writing them out.
    """
    copies, links = _linked(items, train, held, share, buckets)
    # from classes back to records: the held side first, then the training side, hot classes spread
    held_side = skew_join(copies.filter("held = 1").select(F.col("rep").alias("b"), F.col("id").alias("h")), links, ["b"])
    held_side = materialize(held_side.select("a", "h"), "split-held-links")
    out = skew_join(held_side, copies.filter("held = 0").select(F.col("rep").alias("a"), F.col("id").alias("t")), ["a"])
    return out.select(F.least("t", "h").alias("item_id_a"), F.greatest("t", "h").alias("item_id_b")).distinct()


def cross_split_classes(items: DataFrame, train: str = "train", held: tuple[str, ...] = ("validation", "test"), share: float = SHARE, buckets: int = SKETCH) -> DataFrame:
    """(item_id, class_id, n_links): one row a record that matches one of the other side, with its class and the number of its partners.

    class_id is the smallest item_id of the records with the same words. Copies aren't expanded into pairs: what is summed are the
    sizes of linked classes. Input and odd cases as in cross_split_pairs.
    """
    copies, links = _linked(items, train, held, share, buckets)
    links = links.distinct()
    size = copies.groupBy("rep").agg(F.count_if(F.col("held") == 1).alias("n_held"), F.count_if(F.col("held") == 0).alias("n_train"))
    of_train = links.join(size.select(F.col("rep").alias("b"), "n_held"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n_held").alias("n_links")).withColumn("held", F.lit(0).cast("byte"))
    of_held = links.join(size.select(F.col("rep").alias("a"), "n_train"), "a").groupBy(F.col("b").alias("rep")).agg(F.sum("n_train").alias("n_links")).withColumn("held", F.lit(1).cast("byte"))
    counts = materialize(of_train.unionByName(of_held), "split-link-counts")
    return skew_join(copies, counts, ["rep", "held"]).select(F.col("id").alias("item_id"), F.col("rep").alias("class_id"), "n_links")


def overlap_report(items: DataFrame, **params) -> DataFrame:
    """Per held-out split and trimmed source: pairs, held-out records concerned, training records concerned, and all held-out records."""
    held = params.get("held", ("validation", "test"))
    pairs = materialize(cross_split_pairs(items, **params), "split-pairs")
    own = items.filter(F.col("source_split").isin(*held)).select("item_id", "source_split", F.regexp_replace("source", r"^\s+|\s+$", "").alias("source")).dropDuplicates(["item_id"])
    either = pairs.select(F.col("item_id_a").alias("item_id"), F.col("item_id_b").alias("other")).unionByName(pairs.select(F.col("item_id_b").alias("item_id"), F.col("item_id_a").alias("other")))
    hits = either.groupBy("item_id").agg(F.count("*").alias("pairs"))
    return (
        own.join(hits, "item_id", "left")
        .groupBy("source_split", "source")
        .agg(F.count("*").alias("n_records"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )

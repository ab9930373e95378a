"""Records that differ only in formatting: progressive partition refinement.

Level 1 puts every record in a class by invariants that no change of formatting can alter and that need no parsing, sorting or
hashing of the text: the number of letters and digits, their bytes, and a histogram of some of them, all computed in
the JVM. Only the few texts in which escapes may stand are looked at more closely. Only records of classes with several members
reach level 2, the digest of the canonical record (Python, Arrow batches). Both levels aggregate before they shuffle, and what
is shuffled is 24 bytes a record, not text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.llm.records import bare_key
from veritrace.operators.skew import semi_checked, skew_join
from veritrace.runtime import materialize

#: Letters and digits of the histogram; any choice is right. Each is one more pass over the text; more of them split hardly better.
HISTOGRAM = "er19"
_MARKS = re.compile(r"[\W_]+")


#: Letters that case folding writes as several, but for the sharp s, which is treated by itself because it is frequent.
_LONG = {chr(c): chr(c).casefold() for c in range(0x80, 0x110000) if len(chr(c).casefold()) > 1 and chr(c) not in "ßẞ"}

#: Letters that case folding changes although they are in lower case (final sigma, long s and the like).
_VARIANTS = {c: c.casefold() for c in map(chr, range(0x80, 0x110000)) if c.lower() == c != c.casefold() and len(c.casefold()) == 1}
#: Upper-case letters of which lower case makes one of these.
_BEFORE = {c for c in map(chr, range(0x80, 0x110000)) if c.lower() != c and c.lower() in _VARIANTS}


def _near(letters) -> str:
    """A class of a few ranges that holds all the letters (and some others): a quick test whether any can occur."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if ranges and c - ranges[-1][1] <= (16 if c < 0x250 else 256):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def folded(rows: DataFrame, col: str) -> DataFrame:
    """col without difference of case: equal wherever Python's case folding is equal on letters and digits.

    Each step is a projection of its own, so that a text is taken through it once.
    """
    c, rare = F.col(col), F.col("_rare")
    # one look for all letters that lower case alone doesn't fold, or turns into one of those; few texts have any
    rows = rows.withColumn("_rare", (F.octet_length(c) > F.length(c)) & c.rlike(_near({*_LONG, *_VARIANTS, *_BEFORE, "ß", "ẞ"})))
    rows = rows.withColumn(col, F.when(rare, F.regexp_replace(c, "[ßẞ]", "ss")).otherwise(c))
    long = c
    for letter, fold in _LONG.items():
        long = F.replace(long, F.lit(letter), F.lit(_MARKS.sub("", fold)))
    rows = rows.withColumn(col, F.when(rare & c.rlike(_near(_LONG)), long).otherwise(c)).withColumn(col, F.lower(c))
    return rows.withColumn(col, F.when(rare, F.translate(c, "".join(_VARIANTS), "".join(_VARIANTS.values()))).otherwise(c)).drop("_rare")


#: Escapes of JSON that stand for no letter or digit, and those that give a code unit or a pair of them.
_SHORT = r'\\["\\/bfnrt]'
_UNITS = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"


def _unescaped(c: Column) -> Column:
    """JSON text with its escapes as what they stand for, or as a blank if that is no letter or digit."""

    def char(e: Column) -> Column:
        x = F.decode(F.unhex(F.replace(e, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        return F.when(x.rlike(r"[\p{L}\p{N}]"), x).otherwise(" ")

    units = F.array_distinct(F.regexp_extract_all(c, F.lit(_UNITS), F.lit(0)))
    return F.regexp_replace(F.aggregate(units, c, lambda t, e: F.replace(t, e, char(e))), r"\\u[0-9a-fA-F]{4}", " ")


def cheap_class(rows: DataFrame, text: str = "text", name: str = "c1", as_json: bool = False) -> DataFrame:
    """Replaces text by the 64-bit class of what formatting can't change: equal for equal records, mostly different for others.

    The letters and digits of JSON are those of its text as long as no escapes are in it, so it isn't parsed, and the order of
    fields doesn't matter to a count. Text with a backslash that looks like JSON is parsed to see whether it is: if so, its escapes are
    undone; if not, it is taken as it is, and odd says that level 2 may still be able to read it (repeated field names, NaN), so
    that its class as JSON, which as_json gives, counts as well.
    """
    c = F.col(text)
    escaped = F.contains(c, F.lit("\\")) & c.rlike(r"^[\x{feff} \t\r\n]*[\[{]")
    # raw control characters, which the parser doesn't take, are white space wherever they stand
    plain = F.ltrim(F.regexp_replace(c, r"[\x00-\x1f]+", " "), F.lit("\ufeff"))
    # the parser ignores what follows the first value; in a list whose second value is the text's hash, only a text that is one value fits
    listed = F.concat(F.lit("["), plain, F.lit(","), F.xxhash64(c).cast("string"), F.lit("]"))
    whole = F.coalesce(F.try_variant_get(F.try_parse_json(listed), "$[1]", "long") == F.xxhash64(c), F.lit(False))
    rows = rows.withColumn("_escaped", escaped)
    rows = rows.withColumn("_json", F.when(F.col("_escaped"), F.lit(True) if as_json else whole).otherwise(False))
    rows = rows.withColumn("odd", F.col("_escaped") & ~F.col("_json")).withColumn(text, F.when(F.col("_json"), F.regexp_replace(c, _SHORT, " ")).otherwise(c))
    rows = rows.withColumn(text, F.when(F.col("_json") & F.contains(c, F.lit("\\u")), _unescaped(c)).otherwise(c)).drop("_json", "_escaped")
    rows = folded(rows.withColumn(text, F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), text)
    size = F.length(c)
    return rows.withColumn(name, F.xxhash64(size, F.octet_length(c), *[size - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in HISTOGRAM])).drop(text)


def _digests(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        raw = [hashlib.blake2b(bare_key(t), digest_size=16).digest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([int.from_bytes(d[:8], "little", signed=True) for d in raw], pa.int64()), pa.array([int.from_bytes(d[8:], "little", signed=True) for d in raw], pa.int64())],
            names=["id", "k1", "k2"],
        )


def refine(items: DataFrame, id_col: str = "item_id", text_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(level1, keyed, groups) as written tables.

    level1: id, c1 of every record with a text. keyed: id, k1, k2 of the records that share a level-1 class with
    another. groups: k1, k2, keeper, n of the groups of two or more. Null texts are in no group; empty texts, and texts
    without any letter or digit, are equal to one another. A repeated id counts as its own copy once (ids are expected
    to be unique; repeated rows of one id are collapsed). Other columns of items are ignored.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null and id is not null")
    level1 = materialize(cheap_class(rows), "dup-level1")
    odd = level1.filter("odd").select("id").distinct()
    both = level1.select("id", "c1")
    if odd.limit(1).count():
        # what looks like JSON but isn't, in the parser's eyes, is in a second class as well
        odd = materialize(odd, "dup-odd")
        both = both.unionByName(materialize(cheap_class(semi_checked(rows, odd, "id"), as_json=True).select("id", "c1"), "dup-odd-classes"))
    level1 = both
    several = level1.groupBy("c1").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("c1")
    several = materialize(several, "dup-classes")
    left = materialize(semi_checked(level1, several, "c1").select("id").distinct(), "dup-open")
    open_rows = semi_checked(rows, left, "id")
    keyed = materialize(open_rows.mapInArrow(_digests, "id long, k1 long, k2 long").distinct(), "dup-keyed")
    groups = materialize(keyed.groupBy("k1", "k2").agg(F.min("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1"), "dup-groups")
    return level1, keyed, groups


def superfluous_pairs(items: DataFrame, id_col: str = "item_id", text_col: str = "content") -> DataFrame:
    """(item_id_a, item_id_b) of each superfluous copy b and the smallest id a of its group. Empty input gives no rows."""
    _, keyed, groups = refine(items, id_col, text_col)
    return (
        skew_join(keyed, groups, ["k1", "k2"])
        .filter("id <> keeper")
        .select(F.col("keeper").alias("item_id_a"), F.col("id").alias("item_id_b"))
    )


def distinct_records(items: DataFrame, id_col: str = "item_id", text_col: str = "content") -> DataFrame:
    """(item_id, n_copies): one row for each distinct record, kept under its smallest id, with the number of its copies."""
    level1, keyed, groups = refine(items, id_col, text_col)
    grouped = skew_join(keyed, groups, ["k1", "k2"]).select("id", "keeper", "n")
    return (
        level1.select("id").distinct()
        .join(grouped, "id", "left")
        .filter("keeper is null or keeper = id")
        .select(F.col("id").alias("item_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))
    )

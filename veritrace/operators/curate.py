"""Curation of labelled records: decontamination, exact deduplication, balancing, schedules, manifests, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.functions import codec

LABELS = ("safe", "unsafe")


def without_overlap(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Training rows whose key isn't a held-out one (left anti). A null key overlaps with nothing.

    The held-out keys are made distinct first; whether they are broadcast is left to the measured size.
    """
    return train.join(held.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def overlap(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both sides."""
    return train.select(key).intersect(held.select(key)).filter(F.col(key).isNotNull())


def dedup_exact(items: DataFrame, key: str, order: list[str], label: str = "label") -> DataFrame:
    """One row a key: the least by `order`, with n_copies and n_labels (0, 1, or 2 for several); more than one label is a conflict.

    Null keys are left out. Everything is a min, max or count, which aggregate before the one shuffle, so a key with most of the rows
    does no harm.
    """
    rest = [c for c in items.columns if c not in order and c != key]
    return (
        items.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(*order, *rest)).alias("r"), F.count("*").alias("n_copies"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
        .select(key, "r.*", "n_copies", F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") == F.col("_hi"), 1).otherwise(2).cast("long").alias("n_labels"))
    )


def label_conflicts(items: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Keys that occur with different labels."""
    return items.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(label).alias("n_labels"), F.count("*").alias("n_rows")).filter("n_labels > 1")


def seeded_order(seed: int, *parts: Column) -> Column:
    """A place in a seeded permutation: equal on every engine that has SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


#: Rows that one task numbers.
ROWS_A_CELL = 1_000_000


def _offset(cells: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Numbers rows inside their cells (column _cell, in order) and shifts them by the sizes of the cells before."""
    sizes = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    base = sizes.select(F.struct(*by, "_cell").alias("_at"), (F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_n")).alias("_base"))
    inside = cells.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order)))
    # a struct, because a struct with nulls in it is equal to another one
    return inside.withColumn("_at", F.struct(*by, "_cell")).join(base, "_at").withColumn(name, F.col("_base") + F.col("_k")).drop("_cell", "_k", "_base", "_at")


def ranked(df: DataFrame, order: list[Column], name: str = "line", by: list[str] | None = None, buckets: int = 512, rows_a_cell: int = ROWS_A_CELL) -> DataFrame:
    """Adds the row number (from 1) in a total order, without a single task that sorts everything.

    Without `by`, rows are split into ranges of the first order column (which should be a hash in hexadecimal), at least `buckets`
    and more where they would hold more than rows_a_cell rows; they are numbered inside them and shifted by the sizes of the ranges
    before. With `by`, numbers start anew for each key; keys of more than rows_a_cell rows are split at quantiles of the first
    order column (a number or time) in the same way. Rows with the same value of it stay in one range. The numbers of keys are int, of
    all rows long. Nulls are a key like any other, and come first in the order.
    """
    if by:
        counts = df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_a_cell)
        most = counts.agg(F.max("_n")).first()[0]
        if not most:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        pieces = most // rows_a_cell + 1
        steps = [k / pieces for k in range(1, pieces)]
        value = order[0].cast("double")
        hot = df.join(counts.select(F.struct(*by).alias("_key")), F.struct(*by) == F.col("_key"), "left_semi")
        cuts = hot.groupBy(*by).agg(F.percentile_approx(value, steps).alias("_cuts")).select(F.struct(*by).alias("_key"), "_cuts")
        split = df.withColumn("_key", F.struct(*by)).join(cuts, "_key", "left").drop("_key")
        cell = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < value))).otherwise(0)
        return _offset(split.withColumn("_cell", F.coalesce(cell, F.lit(0))).drop("_cuts"), by, order, name).withColumn(name, F.col(name).cast("int"))
    cells = max(buckets, -(-df.count() // rows_a_cell))
    cell = (F.conv(F.substring(order[0], 1, 8), 16, 10).cast("double") * cells / 2.0**32).cast("int")
    whole = df.withColumn("_cell", F.coalesce(cell, F.lit(-1))).withColumn("_all", F.lit(0))
    return _offset(whole, ["_all"], order, name).drop("_all").withColumn(name, F.col(name).cast("long"))


def oversample(items: DataFrame, seed: int, ratio: float, key: str, label: str = "label") -> DataFrame:
    """All rows with oversample_copy 0, and copies of label 1 numbered from 1, up to round-half-even(ratio * label 0).

    Copy c takes label-1 rows in a seeded order of its own; every pass uses each row once, the last one as many as are left.
    Rows with another label stay. 0 < ratio < 1; without rows of both labels nothing is copied; never removes a row.
    """
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    n = items.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    safe, unsafe = (x or 0 for x in n)
    extra = max(0, round(safe * ratio) - unsafe) if safe and unsafe else 0
    base = items.withColumn("oversample_copy", F.lit(0))
    if not extra:
        return base
    passes = -(-extra // unsafe)
    pool = items.filter(F.col(label) == 1)
    whole = pool.withColumn("oversample_copy", F.explode(F.sequence(F.lit(1), F.lit(passes - 1)))) if passes > 1 else pool.withColumn("oversample_copy", F.lit(0)).limit(0)
    left = extra - (passes - 1) * unsafe
    hashed = pool.withColumn("_o", seeded_order(seed, F.lit(passes), F.col(key)))
    last = ranked(hashed, [F.col("_o"), F.col(key)], "_line").filter(F.col("_line") <= left).drop("_o", "_line").withColumn("oversample_copy", F.lit(passes))
    return base.unionByName(whole).unionByName(last)


def strata(items: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Every source with every label, with the rows it has (0 too): sources are few, labels two."""
    have = items.filter(F.col(source).isNotNull() & F.col(label).isin(*LABELS)).groupBy(source, label).agg(F.count("*").alias("n"))
    every = items.filter(F.col(source).isNotNull()).select(source).distinct().withColumn(label, F.explode(F.array(*map(F.lit, LABELS))))
    return every.join(have, [source, label], "left").select(source, label, F.coalesce("n", F.lit(0)).alias("n"))


def balanced_schedule(items: DataFrame, rounds: int, seed: int, key: str, source: str = "source", label: str = "label") -> DataFrame:
    """(key, source, label, draw, is_repeat, prepared_index): one item of each stratum in every round.

    Strata are the sources in order, each with safe before unsafe; odd rounds go through them backwards. A stratum's items
    are drawn in a seeded order, in a new one whenever all have been. Strata without items are left out.
    """
    pools = strata(items, source, label).filter("n > 0").withColumn("k", F.row_number().over(Window.orderBy(source, label)) - 1)
    n_strata = pools.count()
    draws = pools.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("cycle", F.floor(F.col("draw") / F.col("n"))).withColumn("pos", F.col("draw") % F.col("n"))
    cycles = draws.select(source, label, "cycle").distinct()
    pool = items.select(key, source, label).join(F.broadcast(cycles), [source, label])
    # a stratum larger than `rounds` needs only its first rows, which the rank filter keeps per task before the shuffle
    order = Window.partitionBy(source, label, "cycle").orderBy(seeded_order(seed, F.col("cycle"), F.col(key)), key)
    pool = pool.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= rounds).withColumn("pos", (F.col("_k") - 1).cast("long")).drop("_k")
    back = F.when(F.col("draw") % 2 == 0, F.col("k")).otherwise(F.lit(n_strata - 1) - F.col("k"))
    return draws.join(pool, [source, label, "cycle", "pos"]).select(
        key, source, label, "draw", (F.col("draw") >= F.col("n")).alias("is_repeat"), (F.col("draw").cast("long") * n_strata + back).alias("prepared_index")
    )


def count_items(items: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Counts by source and label, by source, by label, and of all; level says which (3 all, 1 source, 2 label, 0 both)."""
    return items.groupingSets([[source, label], [source], [label], []], source, label).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n")).select(source, label, "level", "n")


def first_of_each(items: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key; the rank filter runs before the shuffle as well."""
    return items.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


# What a reward record says of itself.
ABILITY, RULE = "trajectory_safety_classification", "strict_outcome_rule"


def rl_records(items: DataFrame, split: str, index: str = "prepared_index", draw: Column | None = None, repeat: Column | None = None) -> DataFrame:
    """items as records for reinforcement learning: data_source, prompt, ability, reward_model, extra_info, and error; other columns stay.

    items: messages without the answer, source, label (safe or unsafe), reason, content_sha256, source_index, sft_line and the column
    `index`. The trajectory is read back from the last message: error is empty_trajectory where there is none.
    """
    last = F.try_element_at("messages", F.size("messages"))["content"]
    label_int = codec.label_int(F.col("label")).alias("label_int")
    truth = F.struct("label", label_int, "reason", "source", "content_sha256").alias("ground_truth")
    extra = F.struct(
        F.col(index).cast("long").alias("index"), F.lit(split).alias("split"), "source", "source_index", "sft_line", "label", label_int, "content_sha256",
        (F.lit(0) if draw is None else draw).cast("int").alias("sampling_draw"), (F.lit(False) if repeat is None else repeat).alias("sampling_repeat"),
    )
    made = {
        "data_source": F.col("source"), "prompt": F.col("messages"), "ability": F.lit(ABILITY), "reward_model": F.struct(F.lit(RULE).alias("style"), truth), "extra_info": extra,
        "error": F.when(codec.trajectory_of(last) == "", "empty_trajectory"),
    }
    kept = [c for c in items.columns if c not in (*made, "messages", "source", "label", "reason", "content_sha256", "source_index", "sft_line", index)]
    return items.select(*kept, *[c.alias(n) for n, c in made.items()])


def rl_preconditions(train: DataFrame, held: DataFrame) -> DataFrame:
    """One row of what must be 0, 0 and 1: hashes that training has repeatedly, those that held-out items have too, system prompts."""
    sha = train.filter("content_sha256 is not null").groupBy(F.lower("content_sha256").alias("sha")).agg(F.count("*").alias("n"))
    same = train.filter("content_sha256 is not null").groupBy("content_sha256").agg(F.count("*").alias("n"))
    leaked = sha.join(held.select(F.lower("content_sha256").alias("sha")).distinct(), "sha", "left_semi")
    prompts = train.select(F.sha2(F.try_element_at("messages", F.lit(1))["content"], 256).alias("p")).distinct()
    one = lambda df, c, name: df.agg(c.alias("n")).select(F.lit(name).alias("k"), F.col("n").cast("long").alias("n"))
    rows = one(same, F.count_if(F.col("n") > 1), "repeated").unionByName(one(leaked, F.count("*"), "leaked")).unionByName(one(prompts, F.count("p"), "system_prompts"))
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("repeated", "leaked", "system_prompts")])


def ordered_union(first: Column, second: Column) -> Column:
    """The entries of two lists in order, each once: those of the first (repeats there stay), then what only the second has. Null counts as empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(first, empty), F.coalesce(second, empty)
    return F.concat(a, F.array_except(b, a))


def zip_by_line(left: DataFrame, right: DataFrame, line: str | list[str] = "line") -> DataFrame:
    """Full outer join on the line number; status says which side lacks the line."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    status = F.when(F.col("_l").isNull(), "left_missing").when(F.col("_r").isNull(), "right_missing").otherwise("both")
    return a.join(b, line, "full_outer").withColumn("status", status).drop("_l", "_r")


def coalesced(base: DataFrame, override: DataFrame, key: str, value: str) -> DataFrame:
    """Key and value of both sides; the override wins."""
    o = override.select(key, F.col(value).alias("_o"), F.lit(True).alias("_has"))
    return base.join(o, key, "full_outer").select(key, F.when(F.col("_has"), F.col("_o")).otherwise(F.col(value)).alias(value))



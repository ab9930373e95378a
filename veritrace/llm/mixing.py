"""Training records mixed to target shares of the characters: min-cost flow over membership patterns.

Records with the same content form one document, which belongs to all the sources it occurs in. Documents are counted by
membership pattern, so the network has a node for each pattern and use (first, second, ...), a node for each source, and
a quota for each source. An edge leads from a use of a pattern to each of its sources that allows as many uses; the k-th
use costs k - 1, so repetition is the more expensive the more of it there is, and only used where first uses don't
fill the quotas. The total is the largest for which every source that has records meets its share; sources without
records can't, and their share is spread over the others in proportion. Documents are then drawn in a seeded order:
the flow of each pattern and use cuts the running sum of characters into one stretch a source.

Only the pattern counts reach the driver, all of them and with all their sources, as arrays. There is one way for any number of
patterns: MAX_PATTERNS only says how many patterns' stretches are handed to the engine at once, and no result depends on it.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrace.runtime import materialize

SEED = 20260101
#: Stretches of the seeded order of a pattern; running sums are taken inside them and over their totals.
BUCKETS = 1024
#: Patterns whose stretches are handed to the engine at once.
MAX_PATTERNS = 50_000
#: Sources whose membership one long holds.
WORD = 62


class Network:
    """Supply nodes, sinks, and the flow between them, on arrays: routes has the nodes of each sink in ascending order.

    Sinks are few, nodes are many, so that paths are searched among sinks: one leads from sink s to t if some node that sends flow to s
    may send it to t. What all such nodes send is moved at once, which takes a few array operations a step instead of a path
    for each node. The sinks of a node are bits, so that a search reads each edge once.
    """

    def __init__(self, supply: np.ndarray, routes: list[np.ndarray]) -> None:
        self.supply, self.routes = supply.astype(np.int64), routes
        self.bits = np.zeros((len(routes) // WORD + 1, len(supply)), np.int64)
        for s, nodes in enumerate(routes):
            self.bits[s // WORD, nodes] |= 1 << s % WORD

    def reset(self, quota: np.ndarray) -> None:
        self.left, self.room = self.supply.copy(), quota.astype(np.int64)
        self.flow = [np.zeros(len(nodes), np.int64) for nodes in self.routes]

    def _sinks(self, nodes: np.ndarray) -> list[int]:
        """All sinks of the given nodes."""
        found = [int(np.bitwise_or.reduce(b[nodes])) for b in self.bits]
        return [s for s in range(len(self.routes)) if found[s // WORD] >> s % WORD & 1]

    def _shared(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The edges to s and to t of the nodes that send flow to s and have both."""
        a = np.flatnonzero((self.flow[s] > 0) & (self.bits[t // WORD, self.routes[s]] >> t % WORD & 1 > 0))
        return a, np.searchsorted(self.routes[t], self.routes[s][a])

    def reached(self, open_nodes: np.ndarray, room: bool = False) -> dict[int, int | None]:
        """Sinks that the supply left of the open nodes can get to, each with the sink before it, nearest first.

        With room, only as far as the first sink that has any.
        """
        before: dict[int, int | None] = dict.fromkeys(self._sinks(open_nodes & (self.left > 0)))
        queue = deque(before)
        while queue:
            s = queue.popleft()
            if room and self.room[s] > 0:
                break
            if len(before) == len(self.routes):
                continue
            for t in self._sinks(self.routes[s][self.flow[s] > 0]):
                if t not in before:
                    before[t] = s
                    queue.append(t)
        return before

    @staticmethod
    def _shares(have: np.ndarray, amount: int) -> np.ndarray:
        """amount taken from the front of what there is."""
        return np.clip(amount - (np.cumsum(have) - have), 0, have)

    def fill(self, open_nodes: np.ndarray) -> None:
        """Sends as much as possible from the open nodes; flow in place may be rerouted."""
        while True:
            before = self.reached(open_nodes, room=True)
            end = next((s for s in before if self.room[s] > 0), None)
            if end is None:
                return
            path = [end]
            while before[path[-1]] is not None:
                path.append(before[path[-1]])
            first = self.routes[path[-1]]
            have = np.where(open_nodes[first], self.left[first], 0)
            hops = [(s, t, *self._shared(s, t)) for t, s in zip(path, path[1:])]
            amount = min(int(self.room[end]), int(have.sum()), *(int(self.flow[s][a].sum()) for s, _, a, _ in hops))
            for s, t, a, b in hops:  # from the end, so that each sink has given before it takes
                moved = self._shares(self.flow[s][a], amount)
                self.flow[s][a] -= moved
                self.flow[t][b] += moved
            taken = self._shares(have, amount)
            self.flow[path[-1]] += taken
            self.left[first] -= taken
            self.room[end] -= amount

    def fill_by_use(self, uses: np.ndarray, quota: np.ndarray) -> None:
        """Sends as much as quotas take from the nodes, at the least sum of (use - 1) * flow.

        Costs depend on the use alone, so the uses are opened one after the other, each filled by augmenting paths in the
        residual network of all uses opened so far; flow that is in place may be rerouted but never to a dearer use.
        """
        self.reset(quota)
        for use in range(1, int(uses.max(initial=0)) + 1):
            self.fill(uses == use)


def min_cost_flow(supply: dict[tuple, int], routes: dict[tuple, list[str]], quota: dict[str, int]) -> dict[tuple, int]:
    """Flow from (pattern, use) nodes to sources: as much as quotas take, at the least sum of (use - 1) * flow."""
    nodes, names = sorted(supply), sorted(quota)
    net = Network(np.array([supply[n] for n in nodes], np.int64), [np.array([i for i, n in enumerate(nodes) if s in routes[n]], np.int64) for s in names])
    net.fill_by_use(np.array([u for _, u in nodes], np.int64), np.array([quota[s] for s in names], np.int64))
    return {(*nodes[n], s): int(f) for s, at, flow in zip(names, net.routes, net.flow) for n, f in zip(at, flow) if f}


def plan_flow(ends: np.ndarray, members: np.ndarray, chars: np.ndarray, share: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, use, place, characters) of the flow, in this order, and the effective share of each place.

    Pattern k has the places members[ends[k]:ends[k + 1]] and chars[k] characters; share and most uses are by place.

    The total comes from minimum cuts: begin with all that there is; if some sources miss their quotas, those that no
    supply is left for bound the total to what they can get by their share of it. Each such step is a maximum flow, and there are no
    more of them than sources.
    """
    of = np.repeat(np.arange(len(chars)), np.diff(ends))
    present = np.zeros(len(share), bool)
    present[members[chars[of] > 0]] = True
    share = np.where(present & (share > 0) & (most > 0), share, 0.0)
    most = np.where(share > 0, most, 0)
    share = share / (sum(share.tolist()) or 1.0)
    top = np.zeros(len(chars), np.int64)
    np.maximum.at(top, of, most[members])
    start = np.cumsum(top) - top
    pattern = np.repeat(np.arange(len(chars), dtype=np.int32), top)
    use = (np.arange(len(pattern)) - start[pattern] + 1).astype(np.int32)
    net = Network(chars[pattern], [(start[of[members == s]][:, None] + np.arange(most[s])).ravel().astype(np.int32 if len(pattern) < 2**31 else np.int64) for s in range(len(share))])
    everything = np.ones(len(pattern), bool)
    total = int(net.supply.sum())
    while True:
        net.reset(np.floor(share * total))
        net.fill(everything)
        if not net.room.any():
            break
        short = np.ones(len(share), bool)
        short[list(net.reached(everything))] = False
        feeding = np.zeros(len(pattern), bool)
        for s in np.flatnonzero(short):
            feeding[net.routes[s]] = True
        total = min(total - 1, int(net.supply[feeding].sum() / share[short].sum()))
    net.fill_by_use(use, np.floor(share * total))
    used = [np.flatnonzero(f) for f in net.flow]
    node = np.concatenate([np.zeros(0, np.int64), *(at[i] for at, i in zip(net.routes, used))])
    place = np.repeat(np.arange(len(share)), [len(i) for i in used])
    flow = np.concatenate([np.zeros(0, np.int64), *(f[i] for f, i in zip(net.flow, used))])
    order = np.lexsort((place, node))
    node = node[order]
    return pattern[node], use[node], place[order], flow[order], share


def plan_mixture(patterns: dict, targets: dict[str, tuple[float, int]]) -> tuple[dict[tuple, int], dict[str, float]]:
    """plan_flow for patterns id -> (sources, characters) and targets source -> (share, most uses): (flow, effective shares)."""
    names, ids = sorted(targets), sorted(patterns)
    at = {s: i for i, s in enumerate(names)}
    lists = [sorted(at[s] for s in set(patterns[p][0]) if s in at) for p in ids]
    ends, members = np.cumsum([0, *map(len, lists)]), np.array([i for found in lists for i in found], np.int64)
    share, most = (np.array([targets[s][k] for s in names]) for k in (0, 1))
    *flow, share = plan_flow(ends, members, np.array([patterns[p][1] for p in ids], np.int64), share, most)
    return {(ids[p], int(u), names[s]): int(f) for p, u, s, f in zip(*flow)}, {s: float(x) for s, x in zip(names, share) if x}


def _documents(items: DataFrame, names: list[str], train: str) -> tuple[DataFrame, DataFrame]:
    """(docs, members) as written tables: docs h1, h2, pattern, keeper, chars; members h1, h2, item_id, source, label, chars.

    A document's id is two 64-bit hashes of its content; its pattern are the places in `names` of all the sources it occurs in.
    """
    spark = items.sparkSession
    places = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "source string, place int")
    trimmed = F.regexp_replace("source", r"^\s+|\s+$", "")
    rows = (
        items.filter((F.col("source_split") == train) & F.col("content").isNotNull() & F.col("item_id").isNotNull() & (F.length("content") > 0))
        .select("item_id", trimmed.alias("source"), "label", F.xxhash64("content").alias("h1"), F.xxhash64(F.reverse("content"), F.lit(7)).alias("h2"), F.length("content").cast("long").alias("chars"))
        .join(F.broadcast(places), "source")
    )
    members = materialize(rows, "mix-members")
    words = range(len(names) // WORD + 1)
    bit = lambda k: F.bit_or(F.when(F.floor(F.col("place") / WORD) == k, F.expr(f"shiftleft(1L, place % {WORD})")).otherwise(F.lit(0).cast("long")))
    bits = members.groupBy("h1", "h2").agg(F.array(*[bit(k) for k in words]).alias("bits"), F.min("item_id").alias("keeper"), F.max("chars").alias("chars"))
    within = lambda i: F.getbit(F.get("bits", F.floor(i / WORD).cast("int")), i % WORD) == 1
    docs = materialize(bits.select("h1", "h2", F.filter(F.array(*map(F.lit, range(len(names)))).cast("array<int>"), within).alias("pattern"), "keeper", "chars"), "mix-documents")
    return docs, members


def _stretches(spark: SparkSession, docs: DataFrame, names: list[str], listed: dict[str, tuple[float, int]]) -> DataFrame:
    """(pattern, use, source, a, b) as written tables: the stretches of each pattern's seeded order, in characters, that go to a source as the use-th use."""
    counts = docs.groupBy("pattern").agg(F.sum("chars").alias("chars")).orderBy("pattern").toArrow().combine_chunks()
    lists = pa.concat_arrays([*counts["pattern"].chunks, pa.array([], counts.schema.field("pattern").type)])
    share, most = (np.array([listed[s][k] for s in names]) for k in (0, 1))
    pattern, use, place, flow, _ = plan_flow(lists.offsets.to_numpy(), lists.values.to_numpy(), counts["chars"].to_numpy(), share, most)
    b = np.cumsum(flow)
    first = np.flatnonzero((np.diff(pattern, prepend=-1) != 0) | (np.diff(use, prepend=-1) != 0))
    b -= np.repeat((b - flow)[first], np.diff(first, append=len(flow)))
    blocks = []
    for k in range(0, max(len(lists), 1), MAX_PATTERNS):
        rows = slice(*np.searchsorted(pattern, (k, k + MAX_PATTERNS)))
        cuts = {"pattern": lists.take(pa.array(pattern[rows])), "use": use[rows], "source": pa.array(names, pa.string()).take(pa.array(place[rows])), "a": (b - flow)[rows], "b": b[rows]}
        blocks.append(materialize(spark.createDataFrame(pa.table(cuts), "pattern array<int>, use int, source string, a long, b long"), "mix-stretches"))
    return reduce(DataFrame.unionByName, blocks)


def mixture(items: DataFrame, targets: DataFrame, train: str = "train", seed: int = SEED) -> DataFrame:
    """(item_id, source, label, chars, uses): the mixture, one row for each record and source that it stands for.

    items: item_id, source, source_split, label, content; targets: source, target_share, max_repeats; other columns are
    ignored. Sources are trimmed. Null and empty contents, other splits and sources that aren't listed take no part;
    targets that are null, negative or repeated count as 0, 0 and their largest. A document of several sources is
    represented, for each source it was routed to, by its smallest record of that source, and has no more uses in all
    than the most that any of its sources allows. Empty tables give no rows. The same seed gives the same mixture.
    """
    spark = items.sparkSession
    wanted = (
        targets.filter("source is not null").groupBy(F.trim("source").alias("source")).agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("uses"))
    )
    listed = {r.source: (r.share, r.uses) for r in wanted.collect()}
    names = sorted(listed)
    docs, members = _documents(items, names, train)
    stretches = _stretches(spark, docs, names, listed)
    # running sums in two levels, so that a pattern with most of the rows isn't sorted in one task
    order = docs.withColumn("o", F.xxhash64("h1", "h2", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("o", 54).cast("int"))
    order = materialize(order, "mix-order")
    sums = order.groupBy("pattern", "bucket").agg(F.sum("chars").alias("n"))
    base = sums.select("pattern", "bucket", "n", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("base"))
    cuts = base.join(stretches, "pattern").filter("a < base + n and b > base").select("pattern", "bucket", "source", (F.col("a") - F.col("base")).alias("a"), (F.col("b") - F.col("base")).alias("b"))
    within = Window.partitionBy("pattern", "bucket").orderBy("o", "keeper")
    placed = order.withColumn("c", F.sum("chars").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"))
    drawn = placed.join(cuts, ["pattern", "bucket"]).filter("c >= a and c < b").groupBy("h1", "h2", "source").agg(F.count("*").cast("int").alias("uses"))
    drawn = materialize(drawn, "mix-drawn")
    first = members.groupBy("h1", "h2", "source").agg(F.min(F.struct("item_id", "label", "chars")).alias("r"))
    return drawn.join(first, ["h1", "h2", "source"]).select("r.item_id", "source", "r.label", "r.chars", "uses")


def mixture_shares(items: DataFrame, targets: DataFrame, train: str = "train", seed: int = SEED) -> DataFrame:
    """Per source, and per source and label: records, uses, characters, share of all characters, and the target share.

    label_level 0 has one row for every listed source (zeros where it has no record), 1 one for each source and label.
    """
    mixed = materialize(mixture(items, targets, train, seed), "mix-rows")
    used = F.col("chars") * F.col("uses")
    by = mixed.groupingSets([["source", "label"], ["source"]], "source", "label").agg(F.grouping("label").alias("g"), F.count("*").alias("n_records"), F.sum("uses").alias("n_uses"), F.sum(used).alias("n_chars"), F.max("uses").alias("most_uses"))
    total = mixed.agg(F.sum(used)).first()[0] or 0
    want = targets.filter("source is not null").groupBy(F.trim("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    top = want.join(by.filter("g = 1").drop("label"), "source", "left").withColumn("label", F.lit(None).cast("int")).withColumn("label_level", F.lit(0))
    low = by.filter("g = 0").join(want, "source").withColumn("label_level", F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    cols = ["label_level", "source", "label", "target_share", "max_repeats", zero("n_records"), zero("n_uses"), zero("n_chars"), zero("most_uses")]
    return top.select(*cols).unionByName(low.select(*cols)).withColumn("share", F.round(F.coalesce(F.try_divide("n_chars", F.lit(total)), F.lit(0.0)), 6))

"""Mixing the sources of a corpus to target weights.

A transcript may belong to several sources. Transcripts with the same set of
sources are alike for the mix, so only the sets (patterns) and their sizes
enter the optimisation: a min-cost flow from patterns to source quotas in which
each further use of the same words costs more. Transcripts are then drawn in a
seeded order until each pattern has given what the flow takes from it.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cribble.llm.shared import WORD_GAP, settle
from cribble.operators.ranking import MAX_BROADCAST_ROWS

BUDGET = 1.5
MAX_USES = 2
SEED = 17
#: Hex digits of the seeded order that make a bucket: 65,536 per pattern.
PREFIX = 4


def text_size(text: Column) -> Column:
    """Number of words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")
    return F.size(words).cast("bigint")


def source_targets(
    sizes: dict[str | None, int], weights: dict[str | None, float], budget: float = BUDGET,
    max_uses: int = MAX_USES,
) -> dict[str | None, float]:
    """Share ``budget`` times all sizes by weight; no source above ``max_uses`` times its size.

    What a source cannot take is shared again by weight among the others. The
    shares come from one level: filling sources in the order of their limit per
    weight, the level is what is left over the weight that is left.
    """
    left, weight = budget * sum(sizes.values()), sum(weights[s] for s in sizes)
    out: dict[str | None, float] = {}
    order = sorted(sizes, key=lambda s: (max_uses * sizes[s] / weights[s], s is None, s or ""))
    for i, s in enumerate(order):
        if weights[s] * left / weight <= max_uses * sizes[s]:
            level = left / weight
            return out | {t: weights[t] * level for t in order[i:]}
        out[s] = float(max_uses * sizes[s])
        left -= out[s]
        weight -= weights[s]
    return out


def route_flow(
    patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], max_uses: int = MAX_USES,
) -> list[dict[int, int]]:
    """Min-cost flow from patterns to sources: per pattern, the words each source takes.

    ``patterns``: the sources of a pattern and its words. Use u of a pattern's
    words costs u, so first uses are spent before repeats (convex costs). All
    quotas are met as far as capacity allows. Successive shortest paths; since
    a cost level is opened as a whole, each level is a maximum flow over the
    residual graph, which keeps earlier levels full.
    """
    taken: list[dict[int, int]] = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    members: list[list[int]] = [[] for _ in quotas]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            members[s].append(p)
    need = list(quotas)
    for level in range(1, max_uses + 1):
        free = [level * size - sum(t.values()) for t, (_, size) in zip(taken, patterns)]
        for s in range(len(quotas)):
            while need[s] > 0:
                # Breadth first from the source back over patterns that give to others.
                seen, queue, found = {s: None}, deque([s]), None
                while queue and found is None:
                    at = queue.popleft()
                    for p in members[at]:
                        if free[p] > 0:
                            found = (at, p)
                            break
                        for other, n in taken[p].items():
                            if n > 0 and other not in seen:
                                seen[other] = (at, p)
                                queue.append(other)
                if found is None:
                    break
                at, p = found
                path, n = [], min(need[s], free[p])
                while at != s:
                    back, by = seen[at]
                    path.append((at, by, back))
                    n = min(n, taken[by][at])
                    at = back
                free[p] -= n
                need[s] -= n
                taken[p][found[0]] += n
                for gives, by, gets in path:
                    taken[by][gives] -= n
                    taken[by][gets] += n
    return taken


def take_in_order(sized: DataFrame, quota: DataFrame, seed: int = SEED, small: bool = False) -> DataFrame:
    """Add ``taken``: a pattern's quota laid over its transcripts in a seeded order.

    ``sized``: ``id, size, pattern, text_hash, ...``; ``quota``: ``pattern, words,
    pattern_size``. Every transcript is used ``words div pattern_size`` times,
    and the remainder goes once more to those that come first, the last of them
    in part. No pattern is sorted in one task: a histogram of the order's first
    hex digits finds the bucket where the remainder ends, and only that bucket
    is ranked. ``small`` says that the quotas were counted and may be broadcast.
    Transcripts without an id are ordered by their text; those with the same id by
    size and text, so that a rerun can only swap equal ones.
    """
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), "text_hash"), F.lit(str(seed))))
    rows = sized.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, PREFIX))
    buckets = rows.groupBy("pattern", "_bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.when(F.col("pattern_size") > 0, F.col("words") % F.col("pattern_size")).otherwise(F.lit(0))
    full = F.when(F.col("pattern_size") > 0, F.floor(F.col("words") / F.col("pattern_size"))).otherwise(F.lit(0))
    plan = quota.select("pattern", full.cast("bigint").alias("_full"), rest.cast("bigint").alias("_rest"))
    cut = (
        buckets.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plan, "pattern")
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("n")))
        .select("pattern", F.col("_bucket").alias("_cut"), F.col("_rest") - F.col("_before"))
        .toDF("pattern", "_cut", "_inside")
    )
    plan = plan.join(cut, "pattern", "left")
    placed = rows.join(F.broadcast(plan) if small else plan, "pattern", "left")
    at_cut = placed.where(F.col("_bucket") == F.col("_cut"))
    upto = Window.partitionBy("pattern").orderBy("_order", "id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ranked = at_cut.withColumn("_more", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("_inside") - F.coalesce(F.sum("size").over(upto), F.lit(0)))))
    others = placed.where(~F.col("_bucket").eqNullSafe(F.col("_cut"))).withColumn(
        "_more", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(F.lit(0)))
    both = ranked.unionByName(others)
    return both.withColumn("taken", (F.col("_full") * F.col("size") + F.col("_more")).cast("bigint")) \
        .drop("_order", "_bucket", "_cut", "_inside", "_full", "_rest", "_more", "text_hash")


def mix_sources(
    transcripts: DataFrame, weights: list[float], budget: float = BUDGET, max_uses: int = MAX_USES,
    seed: int = SEED,
) -> DataFrame:
    """Choose how often each transcript enters a mix of its sources.

    ``transcripts``: ``id, text, sources`` (array of names; a null or empty
    array, or a null in it, stands for the source without a name); other
    columns are ignored. Sources in order of their names, the nameless one
    last, get the ``weights``, repeating, and share ``budget`` times all words;
    none gets more than ``max_uses`` times its own words.

    Returns one row per input row: ``id, size, sources, taken`` (words taken,
    repeats counted, never over ``max_uses * size``), ``targets`` and
    ``source_sizes`` (in the order of ``sources``). Equal inputs give equal
    mixes. Repeated rows are separate transcripts. Null and empty texts have no
    words and give none. An empty table gives an empty one.

    What reaches the driver is one row per distinct set of sources with its
    words, which depends on the configuration of sources, not on the corpus.
    """
    spark = transcripts.sparkSession
    nameless = F.array(F.lit(None).cast("string"))
    sets = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.array_sort(F.array_distinct("sources"))).otherwise(nameless)
    sized = settle(transcripts.select("id", text_size(F.col("text")).alias("size"), sets.alias("sources"),
                                      F.md5(F.coalesce("text", F.lit(""))).alias("text_hash"))
                   .withColumn("pattern", F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})), "mix")
    found = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: r.pattern)
    names = sorted({s for r in found for s in r.sources}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for r in found:
        for s in r.sources:
            sizes[s] += r.n
    number = {s: i for i, s in enumerate(names)}
    share = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    # A transcript of several sources is one transcript: the budget counts it once.
    total = sum(r.n for r in found)
    scale = total / sum(sizes.values()) if total else 1.0
    targets = source_targets(sizes, share, budget * scale if scale != 1.0 else budget, max_uses)
    flow = route_flow([(tuple(number[s] for s in r.sources), r.n) for r in found],
                      [round(targets[s]) for s in names], max_uses)
    quota = spark.createDataFrame(
        [(r.pattern, sum(t.values()), r.n, [targets[s] for s in r.sources], [sizes[s] for s in r.sources])
         for r, t in zip(found, flow)],
        "pattern string, words bigint, pattern_size bigint, targets array<double>, source_sizes array<bigint>")
    small = len(found) <= MAX_BROADCAST_ROWS
    more = quota.select("pattern", "targets", "source_sizes")
    taken = take_in_order(sized, quota, seed, small)
    return taken.join(F.broadcast(more) if small else more, "pattern").drop("pattern")

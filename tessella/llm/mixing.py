"""Problem 9: sources mixed to target weights by Pfair scheduling.

Size. The total is the largest at which every source reaches its share with no document used more than max_repeats times
(or ``total``, if smaller); so a source gives share * total tokens: whole copies of itself and a part of one more.
Order. Documents of a source follow a hash; their running token counts, a prefix sum made in two steps over hash ranges so
that no source lies in one task, cut the source's sequence into blocks of ``BLOCK`` tokens. Block i of a source of weight w
is released in slot floor(i/w) and due in slot ceil((i+1)/w); the earliest deadline runs first. As weights are ratios, the
schedule repeats after a hyperperiod of at most ``PERIOD`` slots, which is computed once and joined: any prefix of the mix
deviates from every target by less than one block, give or take the document that crosses a block's end. The last
copy takes the documents that end within what is needed, and one is added or exchanged to come closest to it.

Defined results: texts without tokens are not used; sources outside a mix are not used; a source of a mix without documents
makes the exact mix impossible: it gets nothing, is reported with 0, and the others share as their targets stand to each
other; null sources match nothing; rows repeating a doc_id count once; an empty table gives no row.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import cut

BLOCK = 4096
PERIOD = 10_000
RANGE = 50_000


def pfair(weights: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period of sum(weights) slots: earliest deadline first among released blocks."""
    period = sum(weights)
    nxt, slots = [0] * len(weights), [[] for _ in weights]
    for t in range(period):
        due = [(-(-(nxt[s] + 1) * period // w), s) for s, w in enumerate(weights) if nxt[s] < w and nxt[s] * period // w <= t]
        s = min(due)[1]
        slots[s].append(t)
        nxt[s] += 1
    return slots


def _whole_weights(shares: list[float], period: int) -> list[int]:
    """Shares as whole numbers that sum to at most ``period``, by largest remainder, each at least 1."""
    total = sum(shares)
    exact = [x / total * period for x in shares]
    low = [max(1, int(x + 1e-9)) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: low[i] - exact[i])[: max(0, period - sum(low))]:
        low[i] += 1
    g = gcd(*low)
    return [x // g for x in low]


def mix(tokens: DataFrame, targets: DataFrame, total: float | None = None, block: int = BLOCK) -> DataFrame:
    """tokens: doc_id, source, tokens. targets: mix_name, source, target_share, max_repeats, a table that does not grow."""
    spark = tokens.sparkSession
    docs = tokens.where((F.col("tokens") > 0) & F.col("source").isNotNull()).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
    docs = cut(docs.withColumn("h", F.xxhash64("doc_id")))
    sizes = {r.source: (r.w, r.n) for r in docs.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("tokens").alias("w"), F.count("*").alias("n")).collect()}
    plan = _plan(targets.where("target_share > 0").collect(), sizes, total)
    if not plan:
        return spark.createDataFrame([], SCHEMA)
    wanted = spark.createDataFrame([p[:-1] for p in plan], "mix_name string, source string, need double, weight int, period int")
    ranges = max(1, -(-max(n for _, n in sizes.values()) // RANGE))
    docs = docs.join(F.broadcast(wanted.select("source").distinct()), "source").withColumn("r", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    sums = docs.groupBy("source", "r").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "r", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"), F.sum("s").over(Window.partitionBy("source")).alias("whole"))
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(docs.join(sums, ["source", "r"]).withColumn("at", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))))  # used four times below
    used = placed.join(F.broadcast(wanted), "source")
    # whole copies; of one more the documents that end within what is still needed, and the one that fills the gap best
    used = used.withColumn("copies", F.floor(F.round(F.col("need") / F.col("whole"), 9)).cast("int")).withColumn("part", F.col("need") - F.col("copies") * F.col("whole"))
    ends = F.col("at") + F.col("tokens")
    whole_in = ends <= F.col("part")
    gaps = used.groupBy("mix_name", "source", "copies").agg(
        (F.first("part") - F.coalesce(F.max(F.when(whole_in, ends)), F.lit(0))).alias("gap"), F.coalesce(F.max(F.when(whole_in, ends)), F.lit(0)).alias("end"),
        (F.min(F.when(~whole_in, ends)) - F.first("part")).alias("over"), F.min_by(F.when(~whole_in, F.col("doc_id")), F.when(~whole_in, ends)).alias("crossing"),
    )
    used = used.join(F.broadcast(gaps), ["mix_name", "source", "copies"])
    # either one more document fills the gap, or the one that crosses comes in and one of the overshoot's size goes out
    off, out_by = F.abs(F.col("gap") - F.col("tokens")), F.abs(F.col("over") - F.col("tokens"))
    more, less = F.when(~whole_in, off), F.when(whole_in, out_by)
    fix = used.groupBy("mix_name", "source").agg(F.min(more).alias("m"), F.min(less).alias("l"), F.first("gap").alias("g"), F.min_by("doc_id", F.when(~whole_in, F.struct(off, "h", "doc_id"))).alias("filler"), F.min_by("doc_id", F.when(whole_in, F.struct(out_by, "h", "doc_id"))).alias("goes"))
    big = F.lit(1e18)
    m, l, g = F.coalesce(F.col("m"), big), F.coalesce(F.col("l"), big), F.col("g")
    fix = fix.select("mix_name", "source", F.when((m <= l) & (m < g), F.col("filler")).alias("filler"), F.when((l < m) & (l < g), F.col("goes")).alias("goes"))
    used = used.join(F.broadcast(fix), ["mix_name", "source"], "left")
    is_ = lambda c: F.coalesce(F.col("doc_id") == F.col(c), F.lit(False))
    extra = (whole_in & ~is_("goes")) | is_("filler") | (F.col("goes").isNotNull() & is_("crossing"))
    n = F.col("copies") + extra.cast("int")
    used = used.withColumn("repeat_no", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    at = F.when((F.col("repeat_no") == F.col("copies")) & (ends > F.col("part")), F.col("end")).otherwise(F.col("at"))
    used = used.withColumn("at", F.col("repeat_no") * F.col("whole") + at).withColumn("block_no", F.floor(F.col("at") / block))
    slots = spark.createDataFrame([(p[0], p[1], j, t) for p in plan for j, t in enumerate(p[-1])], "mix_name string, source string, j int, t int")
    used = used.withColumn("j", (F.col("block_no") % F.col("weight")).cast("int")).join(slots, ["mix_name", "source", "j"])
    slot = F.floor(F.col("block_no") / F.col("weight")) * F.col("period") + F.col("t")
    return used.select("mix_name", slot.alias("slot"), "source", "block_no", F.col("at").alias("source_offset"), "doc_id", "repeat_no", "tokens")


SCHEMA = "mix_name string, slot bigint, source string, block_no bigint, source_offset bigint, doc_id bigint, repeat_no int, tokens bigint"


def _plan(targets, sizes, total):
    """Rows mix, source, tokens needed, whole-number weight, period, slots."""
    out = []
    for name in sorted({t.mix_name for t in targets}):
        own = sorted((t for t in targets if t.mix_name == name and t.source in sizes), key=lambda t: t.source)
        if not own:
            continue
        shares = [t.target_share / sum(x.target_share for x in own) for t in own]
        size = min(sizes[t.source][0] * t.max_repeats / s for t, s in zip(own, shares))
        size = min(size, total) if total else size
        weights = _whole_weights(shares, PERIOD)
        for t, s, w, at in zip(own, shares, weights, pfair(weights)):
            out.append((name, t.source, float(s * size), w, sum(weights), at))
    return out


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source of every mix."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_used"), F.countDistinct("doc_id").alias("n_docs"), (F.max("repeat_no") + 1).alias("most_used"))
    all_ = Window.partitionBy("mix_name")
    out = targets.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_used", "n_docs", "most_used"])
    return out.select("mix_name", "source", "target_share", "max_repeats", "tokens", "n_used", "n_docs", "most_used", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(all_), F.lit(0)), F.lit(0.0)).alias("reached_share"))

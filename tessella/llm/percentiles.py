"""Problem 7: exact and mergeable percentiles by distributed multi-select.

Select. Values are pre-aggregated to (group, value, n) on the map side. Every (group, quantile) is a search with a rank
and an open range of values; searches of one group share their range until their ranks part. In each round the partitions
propose the weighted median of what they hold inside each range; the weighted median of the proposals is the pivot; one
aggregation counts three ways, below, at and above the pivot; ranges that cannot hold the wanted rank are discarded, and
the values outside all ranges are dropped. Rounds go on, for all groups alike, until every element is found: the ranges of a
group are disjoint, so a round handles each value at most once, and what is left falls by a fixed share. Nothing is sampled
or sorted whole, and no group is brought into one task. The result is the nearest-rank percentile, the element of rank
ceil(q * N).

Merge. A day's mergeable result is a table (group, day, bucket, n) whose buckets keep the value's ``BITS`` leading bits, so
its length is bounded by BITS and the type's range whatever the number of rows. The percentile over all days is selected
from these tables alone; the middle of its bucket is off by at most 2**-BITS of the value (``error_bound``).

Defined results: null, zero and negative values are no measurements and do not count; null and blank group labels form one
group, shown as null; repeated lines count once; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

QUANTILES = (0.5, 0.9, 0.95, 0.99)
#: Leading bits that a bucket keeps.
BITS = 8


#: Rows that a partition sorts at once for its proposals; a larger one makes several.
ROWS = 2_000_000


def _proposals(batches):
    """Per partition and range: the weighted median of the values inside, with the weight it stands for."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows > ROWS:
            yield _medians(held)
            held, rows = [], 0
    if rows:
        yield _medians(held)


def _medians(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    g, lo, v, n = (np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in held]) for c in ("g", "lo", "v", "n"))
    order = np.lexsort((v, lo, g))
    g, lo, v, n = g[order], lo[order], v[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (lo[1:] != lo[:-1])]))
    total = np.add.reduceat(n, first)
    upto = np.cumsum(n)
    at = np.searchsorted(upto, upto[first] - n[first] + (total + 1) // 2)
    return pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(lo[first]), pa.array(v[at]), pa.array(total)], ["g", "lo", "v", "n"])


def select(values: DataFrame, keys: list[str], quantiles=QUANTILES) -> DataFrame:
    """values: keys, v bigint, n bigint. One row a group and quantile: keys, q, n (all counts), v (the element of rank ceil(q*n))."""
    values = cut(values.groupBy(*keys, "v").agg(F.sum("n").alias("n")).withColumn("g", F.xxhash64(*keys)))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    lo, hi = F.lit(-(2**62)).cast("long"), F.lit(2**62).cast("long")
    # rank: how many elements up to the wanted one lie inside the range
    state = values.groupBy("g", *keys).agg(F.sum("n").alias("total")).select("g", *keys, "total", qs)
    state = cut(state.select("*", F.ceil(F.round(F.col("q") * F.col("total"), 6)).cast("long").alias("rank"), lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("long").alias("v")))
    cand = values.select("g", "v", "n", lo.alias("lo"))
    v, p, r, n = (F.col(c) for c in ("v", "p", "rank", "n"))
    while not state.where(v.isNull()).isEmpty():
        props = cand.select("g", "lo", "v", "n").mapInArrow(_proposals, "g long, lo long, v long, n long")
        pivots = props.groupBy("g", "lo").agg(F.percentile("v", F.lit(0.5), F.col("n")).cast("long").alias("p"))
        below = F.sum(F.when(v < p, n).otherwise(0)).alias("n_lt")
        counts = cand.join(pivots, ["g", "lo"]).groupBy("g", "lo", "p").agg(below, F.sum(F.when(v == p, n).otherwise(0)).alias("n_eq"))
        s = state.join(counts, ["g", "lo"], "left")
        open_ = v.isNull() & p.isNotNull()
        under, above = open_ & (r <= F.col("n_lt")), open_ & (r > F.col("n_lt") + F.col("n_eq"))
        state = cut(s.select(
            "g", *keys, "total", "q", F.when(above, r - F.col("n_lt") - F.col("n_eq")).otherwise(r).alias("rank"),
            F.when(above, p).otherwise(F.col("lo")).alias("lo"), F.when(under, p).otherwise(F.col("hi")).alias("hi"), F.when(open_ & ~under & ~above, p).otherwise(v).alias("v"),
        ), estimate=False)
        # ranges of one group are the same or disjoint, so that a value stays at most once
        ranges = state.where(v.isNull()).select(F.col("g").alias("g_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_")).distinct()
        cand = cut(cand.join(ranges, (F.col("g") == F.col("g_")) & (v > F.col("lo_")) & (v < F.col("hi_"))).select("g", "v", "n", F.col("lo_").alias("lo")), estimate=False)
    return state.select(*keys, "q", F.col("total").alias("n"), "v")


def bucket(v, bits: int = BITS):
    """Column: the lowest value of v's bucket, v with all but its ``bits`` leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def bucket_middle(b, bits: int = BITS):
    """Column: the middle of the bucket that begins at b."""
    shift = F.greatest(F.length(F.bin(b)) - bits, F.lit(0))
    return b + (F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1) / F.lit(2.0)


def measured(df: DataFrame, value: str, groups: list[str], stamp: str, identity: list[str]) -> DataFrame:
    """The measurements: value > 0, repeated lines once, blank labels null, the day from the stamp."""
    label = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    one = df.where(F.col(value) > 0).dropDuplicates(identity)
    return one.select(*[label(c) for c in groups], F.to_date(stamp).alias("day"), F.col(value).cast("long").alias("v"))


def daily_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The mergeable daily result: groups, day, bucket, n."""
    return rows.groupBy(*groups, "day", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(rows: DataFrame, groups: list[str]) -> DataFrame:
    """rows: groups, day, v. Daily percentiles, exact, and total ones made from the daily summaries alone."""
    rows = cut(rows.groupBy(*groups, "day", "v").agg(F.count("*").alias("n")))
    daily = rows.select(F.lit("day").alias("scope"), *groups, "day", "v", "n")
    summary = rows.groupBy(*groups, "day", bucket(F.col("v")).alias("v")).agg(F.sum("n").alias("n"))
    total = summary.groupBy(*groups, "v").agg(F.sum("n").alias("n")).select(F.lit("total").alias("scope"), *groups, F.lit(None).cast("date").alias("day"), "v", "n")
    out = select(daily.unionByName(total), ["scope", *groups, "day"])  # all searches go through the same rounds
    whole = F.col("scope") == "total"
    return out.select("scope", *groups, "day", "q", "n", F.when(whole, bucket_middle(F.col("v"))).otherwise(F.col("v").cast("double")).alias("value"), F.when(whole, F.lit(2.0**-BITS)).otherwise(F.lit(0.0)).alias("error_bound"))

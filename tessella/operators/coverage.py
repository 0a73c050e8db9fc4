"""Alignment coverage of translations: which words are reached by aligned chunks. All in-row array work, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stopwords import STOP
from tessella.functions.text import RUN, WORD, offsets


def overlaps(w: Column, c: Column) -> Column:
    return (c["t0"] < w["e"]) & (w["s"] < c["t1"])


def covered(words: Column, align: Column, with_source: bool = True) -> Column:
    """The words that a chunk (with a source word, unless told otherwise) overlaps."""
    return F.filter(words, lambda w: F.exists(align, lambda c: overlaps(w, c) & ((F.size(c["w"]) > 0) if with_source else F.lit(True))))


def coverage_q(text: Column, align: Column) -> Column:
    """Covered runs of letters and digits by all such runs, two places; 0 when there are none or nothing is aligned."""
    runs = offsets(text, RUN)
    return F.when(F.size(runs) > 0, F.round(F.size(covered(runs, F.coalesce(align, F.array()))) / F.size(runs), 2)).otherwise(F.lit(0.0))


def measure(df: DataFrame, stop: dict[str, list[str]] = STOP) -> DataFrame:
    """df: text, align, words (of the source), target. Adds n_tgt, n_tgt_covered, n_src, n_src_tapped, n_chunks, q_runs,
    n_content and n_content_covered, the words left when the target's stop words go (all where none is left or no list is)."""
    none = F.array().cast("array<struct<t0:int,t1:int,w:array<int>>>")
    align, words = F.coalesce(F.col("align"), none), F.coalesce(F.col("words"), F.array().cast("array<struct<s:int,e:int>>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = F.create_map(*[x for k, v in stop.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    df = df.withColumn("_a", align).withColumn("_tw", offsets(text, WORD)).withColumn("_stop", F.coalesce(F.try_element_at(lists, F.lower(F.trim("target"))), F.array().cast("array<string>")))
    content = F.filter("_tw", lambda w: ~F.array_contains(F.col("_stop"), F.lower(F.substring(text, w["s"] + 1, w["e"] - w["s"]))))
    df = df.withColumn("_cw", content).withColumn("_cw", F.when(F.size("_cw") > 0, F.col("_cw")).otherwise(F.col("_tw")))
    tapped = F.array_distinct(F.filter(F.flatten(F.transform("_a", lambda c: c["w"])), lambda i: (i >= 0) & (i < F.size(words))))
    out = df.select(
        "*", F.size("_tw").alias("n_tgt"), F.size(covered(F.col("_tw"), F.col("_a"))).alias("n_tgt_covered"), F.size(words).alias("n_src"), F.size(tapped).alias("n_src_tapped"), F.size("_a").alias("n_chunks"),
        F.size("_cw").alias("n_content"), F.size(covered(F.col("_cw"), F.col("_a"))).alias("n_content_covered"), coverage_q(text, F.col("_a")).alias("q_runs"),
    )
    return out.drop("_a", "_tw", "_cw", "_stop")


def ratio(a, b, empty: float = -1.0) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def upper_median(c) -> Column:
    """The element n/2, counted from 0, of the ascending values; nulls don't count."""
    xs = F.array_sort(F.collect_list(c))
    return F.try_element_at(xs, (F.floor(F.size(xs) / 2) + 1).cast("int"))


def ranked_median(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Upper medians without collecting a group: values are counted, and running counts find the element n/2."""
    from pyspark.sql.window import Window

    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    return n.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def decile(c) -> Column:
    return F.least(F.greatest(F.floor(c * 10), F.lit(0)), F.lit(9)).cast("int")

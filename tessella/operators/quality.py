"""Quality of aligned answers: scores by word, coverage by chunk, probes of expressions, what a judge is asked and what it says.

All of it is in-row array work over the answer's text, its alignment and the source's words, but for the samples and tallies.
Defined results: null texts, alignments and words are empty ones; a ratio of nothing is -1 in scores, 0 in chunk coverage, 1 in
reports; spans outside the text are cut to it, and empty ones tell nothing; a language without a list has no stop words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions.stopwords import STOP
from tessella.operators.coverage import covered, overlaps, ratio
from tessella.operators.corpus import clean_sample
from tessella.session import cut

ALIGN = "array<struct<t0:int,t1:int,w:array<int>>>"
WORDS = "array<struct<s:int,e:int>>"


def stop_list(lang: Column, lists: dict[str, list[str]] = STOP) -> Column:
    """The stop words of a language; none for one without a list."""
    known = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(lang))), F.array().cast("array<string>"))


def _prepared(df: DataFrame) -> DataFrame:
    """df: text, align, src, words. Nulls become empty; _tw are the words of the text."""
    return df.select(
        *[c for c in df.columns if c not in ("text", "align", "src", "words")], F.coalesce("text", F.lit("")).alias("text"), F.coalesce("align", F.array().cast(ALIGN)).alias("align"),
        F.coalesce("src", F.lit("")).alias("src"), F.coalesce("words", F.array().cast(WORDS)).alias("words"),
    ).withColumn("_tw", T.offsets("text"))


def _cut(text: str, w: Column) -> Column:
    return F.substring(F.col(text), w["s"] + 1, w["e"] - w["s"])


def scores(df: DataFrame) -> DataFrame:
    """df: source_lang, target, text, align, src, words. Adds cov_all, cov_content (words of the answer that any chunk meets), tap_all,
    tap_content (words of the source that any chunk names), and the content words that are not, in order."""
    x = _prepared(df).withColumn("_ts", stop_list(F.col("target"))).withColumn("_ss", stop_list(F.col("source_lang")))
    x = x.withColumn("_tapped", F.array_distinct(F.flatten(F.transform("align", lambda c: c["w"]))))
    met = lambda w: F.exists("align", lambda c: overlaps(w, c))
    content = F.filter("_tw", lambda w: ~F.array_contains("_ts", F.lower(_cut("text", w))))
    named = F.transform("words", lambda w, i: F.struct(_cut("src", w).alias("w"), F.array_contains("_tapped", i.cast("int")).alias("hit")))
    x = x.withColumn("_tc", content).withColumn("_sw", named)
    x = x.withColumn("_sc", F.filter("_sw", lambda w: ~F.array_contains("_ss", F.lower(w["w"]))))
    hits = lambda c: F.size(F.filter(c, lambda w: w["hit"]))
    out = x.select(
        *df.columns, ratio(F.size(F.filter("_tw", met)), F.size("_tw")).alias("cov_all"), ratio(F.size(F.filter("_tc", met)), F.size("_tc")).alias("cov_content"),
        ratio(hits("_sw"), F.size("_sw")).alias("tap_all"), ratio(hits("_sc"), F.size("_sc")).alias("tap_content"),
        F.transform(F.filter("_sc", lambda w: ~w["hit"]), lambda w: w["w"]).alias("uncovered_src"), F.transform(F.filter("_tc", lambda w: ~met(w)), lambda w: _cut("text", w)).alias("uncovered_tgt"),
    )
    return out


def local_coverage(text: Column, align: Column) -> Column:
    """Of the chunks with a letter or digit, the share that has a source word; 0 when there are none."""
    n = F.length(text)
    piece = lambda c: F.substring(text, F.greatest(c["t0"], F.lit(0)) + 1, F.least(c["t1"], n) - F.greatest(c["t0"], F.lit(0)))
    real = F.filter(F.coalesce(align, F.array().cast(ALIGN)), lambda c: (F.greatest(c["t0"], F.lit(0)) < F.least(c["t1"], n)) & piece(c).rlike(r"[\p{L}\p{Nd}]"))
    return F.coalesce(F.when(F.size(real) > 0, F.size(F.filter(real, lambda c: F.size(c["w"]) > 0)) / F.size(real)), F.lit(0.0))


def content_q(df: DataFrame) -> DataFrame:
    """df: target, text, align. Adds q_all and q_content: covered words by words, chunks without a source word not counting; all words
    where the language has no list or the text no content word; 0 without words."""
    x = df.withColumn("_a", F.coalesce("align", F.array().cast(ALIGN))).withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_tw", T.offsets("_t")).withColumn("_s", stop_list(F.col("target")))
    x = x.withColumn("_c", F.filter("_tw", lambda w: ~F.array_contains("_s", F.lower(_cut("_t", w))))).withColumn("_c", F.when(F.size("_c") > 0, F.col("_c")).otherwise(F.col("_tw")))
    share = lambda c: ratio(F.size(covered(F.col(c), F.col("_a"))), F.size(c), 0.0)
    return x.select(*df.columns, share("_tw").alias("q_all"), share("_c").alias("q_content"))


def content_chunks(text: Column, align: Column, target: Column) -> Column:
    """The chunks whose whole span is not a stop word; spans outside the text go."""
    stop = stop_list(target)
    ok = lambda c: (c["t0"] >= 0) & (c["t1"] <= F.length(text)) & (c["t0"] < c["t1"])
    return F.filter(align, lambda c: ok(c) & ~F.array_contains(stop, F.lower(F.substring(text, c["t0"] + 1, c["t1"] - c["t0"]))))


def probes(df: DataFrame, far: int = 3) -> DataFrame:
    """df: expr, target, text, align, src, words. Adds verdict and fragments: 'expr-not-found', 'unaligned', 'unit' when every word of
    the expression is named and its chunks stand together (at most ``far`` places on, at most one stop word between), else
    'partial'. The expression is looked for as a sequence of words, in small letters."""
    x = _prepared(df).withColumn("_want", F.transform(T.words("expr"), F.lower)).withColumn("_ws", F.transform("words", lambda w: F.lower(_cut("src", w))))
    k = F.size("_want")
    places = F.when((k > 0) & (F.size("_ws") >= k), F.sequence(F.lit(0), F.size("_ws") - k)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("_at", F.try_element_at(F.filter(places, lambda i: F.slice("_ws", i + 1, k) == F.col("_want")), F.lit(1)))
    n = F.length("text")
    chunk = lambda c: F.struct(F.greatest(c["t0"], F.lit(0)).alias("a"), F.least(c["t1"], n).alias("b"), F.filter(c["w"], lambda i: (i >= F.col("_at")) & (i < F.col("_at") + k)).alias("w"))
    x = x.withColumn("_ch", F.array_sort(F.filter(F.transform("align", chunk), lambda c: c["a"] < c["b"])))
    x = x.withColumn("_ref", F.filter(F.transform("_ch", lambda c, i: F.struct(i.alias("i"), c["a"].alias("a"), c["b"].alias("b"), c["w"].alias("w"))), lambda c: F.size(c["w"]) > 0))
    x = x.withColumn("_stop", stop_list(F.col("target")))
    gap = lambda p, q: F.filter("_tw", lambda w: (w["s"] >= p["b"]) & (w["e"] <= q["a"]))
    near = lambda p, q: (q["i"] - p["i"] <= far) & ((F.size(gap(p, q)) == 0) | ((F.size(gap(p, q)) == 1) & F.forall(gap(p, q), lambda w: F.array_contains("_stop", F.lower(_cut("text", w))))))
    steps = F.zip_with(F.slice("_ref", 1, F.greatest(F.size("_ref") - 1, F.lit(0))), F.slice("_ref", 2, F.greatest(F.size("_ref") - 1, F.lit(0))), near)
    whole = F.size(F.array_distinct(F.flatten(F.transform("_ref", lambda c: c["w"])))) == k
    verdict = F.when(F.col("_at").isNull(), "expr-not-found").when(F.size("_ref") == 0, "unaligned").when(whole & F.forall(steps, lambda s: s), "unit").otherwise("partial")
    return x.select(*df.columns, verdict.alias("verdict"), F.transform("_ref", lambda c: F.substring("text", c["a"] + 1, c["b"] - c["a"])).alias("fragments"))


def align_pairs(src: Column, words: Column, text: Column, align: Column) -> Column:
    """The alignment as pairs of a fragment and its source words, for a judge; inserted fragments have none."""
    n, m = F.length(text), F.length(src)
    word = lambda i: F.try_element_at(words, i + 1)
    named = lambda c: F.filter(c["w"], lambda i: (i >= 0) & (i < F.size(words)) & (word(i)["s"] >= 0) & (word(i)["e"] <= m) & (word(i)["s"] < word(i)["e"]))
    a, b = (lambda c: F.greatest(c["t0"], F.lit(0))), (lambda c: F.least(c["t1"], n))
    real = F.filter(align, lambda c: a(c) < b(c))
    return F.transform(real, lambda c: F.array(F.substring(text, a(c) + 1, b(c) - a(c)), F.array_join(F.transform(named(c), lambda i: F.substring(src, word(i)["s"] + 1, word(i)["e"] - word(i)["s"])), " ")))


def judge_scope(df: DataFrame, least: float = 0.7, share: int = 20) -> DataFrame:
    """df: src, q, flagged (one row an answer). One row a source to be judged, with why: 'flagged' by the lexicon in any answer, 'low'
    coverage in any, or 'sample', one of ``share`` of the clean rest by the hash of its text."""
    per = cut(df.groupBy("src").agg(F.max(F.coalesce("flagged", F.lit(False))).alias("f"), F.min("q").alias("q")))  # used three times below
    why = F.when(F.col("f"), "flagged").when(F.col("q") < least, "low")
    suspect = per.where(why.isNotNull()).select("src", why.alias("why"))
    return suspect.unionByName(clean_sample(per.where(why.isNull()).select("src"), "src", share).select("src", F.lit("sample").alias("why")))


def verdict_tally(verdicts: DataFrame) -> DataFrame:
    """verdicts: src, ok (null: not judged), why. One row: checked, flagged, unjudged, and the flagged sources; and the reasons by count
    come from ``verdict_reasons``."""
    bad = F.coalesce(~F.col("ok"), F.lit(False))
    return verdicts.agg(F.count("*").alias("n_checked"), F.count_if(bad).alias("n_flagged"), F.count_if(F.col("ok").isNull()).alias("n_unjudged"), F.countDistinct(F.when(bad, F.col("src"))).alias("n_flagged_srcs"))


def verdict_reasons(verdicts: DataFrame) -> DataFrame:
    """Reasons of flagged verdicts: trimmed, at most 60 characters, 'unspecified' where blank."""
    why = F.substring(F.trim(F.coalesce("why", F.lit(""))), 1, 60)
    return verdicts.where(~F.col("ok")).groupBy(F.when(why == "", "unspecified").otherwise(why).alias("why")).agg(F.count("*").alias("n"))

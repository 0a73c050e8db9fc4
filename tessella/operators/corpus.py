"""Sentences of documents, comparison of two versions, keyed results, context, chapters, lexicon support, judging."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.session import cut


def paragraphs_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One paragraph a non-blank line: key, para_idx, text (cleaned)."""
    lines = docs.select("*", F.posexplode(F.split(text, "\n")).alias("para_idx", "_line")).withColumn("_line", T.clean("_line"))
    return lines.where("_line <> ''").select(*[c for c in docs.columns if c != text], "para_idx", F.col("_line").alias("text"))


def sentences_of(paras: DataFrame) -> DataFrame:
    """One row a sentence by the mark-blank-capital rule, with its place."""
    rest = [c for c in paras.columns if c != "text"]
    return paras.select(*rest, F.posexplode(T.rule_sentences("text")).alias("sent_idx", "src")).where("src <> ''")


def occurrences(df: DataFrame, src: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Numbers the occurrences of a text in reading order, from 0. A line that recurs everywhere is spread over ranges."""
    keys = [*(by or []), src]
    return within(df, keys, order, "occurrence")


def within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Places from 0 within a key, in that order, without one task holding a key: global places less the key's first one."""
    at = numbered(df, [*keys, *order], "_at_all")
    first = at.groupBy(*keys).agg(F.min("_at_all").alias("_first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = at.alias("a").join(first.alias("b"), same)
    return out.select("a.*", F.col("b._first").alias("_first")).withColumn(name, F.col("_at_all") - F.col("_first")).drop("_at_all", "_first")


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Numbers consecutive batches of ``size`` rows within a key, from 0."""
    return within(df, keys, order, "_nth").withColumn("batch", F.floor(F.col("_nth") / size)).drop("_nth")


def matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th occurrence of a text in one version with the k-th in the other; columns of b get the suffix _b."""
    other = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return a.join(other, keys)


def pending(wanted: DataFrame, store: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """What is wanted and not stored, each key once; stored artefacts and blanks don't count as stored."""
    good = store.where((F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & ~T.is_artifact(text)).select(key)
    return wanted.dropDuplicates([key]).join(good, key, "left_anti")


def filled(wanted: DataFrame, final: DataFrame, raw: DataFrame, key: str = "key") -> DataFrame:
    """The final text, else the raw one with its list number restored, else empty; artefacts are skipped."""
    return levels(wanted.join(final.select(key, F.col("text").alias("_f")), key, "left").join(raw.select(key, F.col("text").alias("_r")), key, "left"))


def levels(df: DataFrame) -> DataFrame:
    """df: src, _f, _r (final and raw text or null). Adds the text that fills and its level: final, raw or none."""
    ok = lambda c: F.when(~T.is_artifact(c) & (F.trim(F.col(c)) != ""), F.col(c))
    return df.withColumn("text", F.coalesce(ok("_f"), T.restore_list_mark("src", ok("_r")), F.lit(""))).withColumn("level", F.when(ok("_f").isNotNull(), "final").when(ok("_r").isNotNull(), "raw").otherwise("none")).drop("_f", "_r")


def previous_context(df: DataFrame, by: list[str], order: list[str], n: int, src: str, tr: str) -> DataFrame:
    """The up to n sentences before, with their translations; untranslated ones are skipped and not replaced."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    got = F.filter(F.collect_list(F.struct(F.col(src).alias("src"), F.coalesce(F.col(tr), F.lit("")).alias("tr"))).over(w), lambda x: x["tr"] != "")
    return df.withColumn("context", got)


def carried(df: DataFrame, by: list[str], order: list[str], is_start: Column, name: str = "section") -> DataFrame:
    """Numbers the section each row belongs to, from the last row that starts one; 0 before the first."""
    return df.withColumn(name, F.sum(is_start.cast("int")).over(Window.partitionBy(*by).orderBy(*order)))


def without_loose_breaks(df: DataFrame, by: list[str], order: list[str], is_break: Column) -> DataFrame:
    """Scene breaks only between contents: leading and trailing ones go, runs become one."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(F.when(~is_break, 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.max(F.when(~is_break, 1)).over(w.rowsBetween(1, Window.unboundedFollowing))
    prev = F.lag(is_break).over(w)
    marked = df.withColumn("_keep", ~is_break | (before.isNotNull() & after.isNotNull() & ~F.coalesce(prev, F.lit(False))))
    return marked.where("_keep").drop("_keep")


def lexicon(pairs: DataFrame, least: int = 3, top: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs: s, t (folded words that stand in a sentence and its translation). The most frequent targets of each word; a
    lexicon for each of the columns ``by``."""
    return _ranked(pairs.groupBy(*by, "s", "t").agg(F.count("*").alias("n")).where(F.col("n") >= least), top, by)


def lexicon_of(texts: DataFrame, least: int = 3, top: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """texts: by, ss, ts (distinct folded words of a sentence and its translation). As lexicon over all pairs of their words, which are
    counted as numbers: words and groups travel as 64-bit hashes, and only the pairs that are frequent enough get their names back."""
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    x = texts.select(group.alias("_g"), F.explode(hashed("ss")).alias("_s"), hashed("ts").alias("_t")).select("_g", "_s", F.explode("_t").alias("_t"))
    n = x.groupBy("_g", "_s", "_t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    words = texts.select(F.explode(F.array_union("ss", "ts")).alias("w")).distinct().select(F.xxhash64("w").alias("_h"), "w")
    named = n.join(words.select(F.col("_h").alias("_s"), F.col("w").alias("s")), "_s").join(words.select(F.col("_h").alias("_t"), F.col("w").alias("t")), "_t")
    if by:
        named = named.join(texts.select(*by).distinct().withColumn("_g", group), "_g")
    return _ranked(named.select(*by, "s", "t", "n"), top, by)


def _ranked(n: DataFrame, top: int, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by, "s").orderBy(F.desc("n"), F.desc("t"))
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def chunk_words(answers: DataFrame, align: Column, keys: list[str]) -> DataFrame:
    """answers: keys, src, text, words. One row a word that a chunk is asked about: keys, chunk, own, s, t (both folded). Own are
    the chunk's words; the others are the words before its first and behind its last one. Fragments and own words of fewer than
    three letters tell nothing."""
    c = answers.select(*keys, "src", "text", "words", F.posexplode(align).alias("chunk", "c")).where((F.size("c.w") > 0) & (F.col("c.t0") >= 0) & (F.col("c.t1") <= F.length("text")) & (F.col("c.t0") < F.col("c.t1")))
    c = c.withColumn("t", T.fold_letters(F.substring("text", F.col("c.t0") + 1, F.col("c.t1") - F.col("c.t0")))).where(F.length("t") >= 3)
    near = F.array(F.element_at("c.w", 1) - 1, F.element_at("c.w", -1) + 1)
    asked = F.concat(F.transform("c.w", lambda i: F.struct(i.alias("i"), F.lit(True).alias("own"))), F.transform(near, lambda i: F.struct(i.alias("i"), F.lit(False).alias("own"))))
    w = c.select(*keys, "chunk", "t", "src", "words", F.explode(asked).alias("x")).where((F.col("x.i") >= 0) & (F.col("x.i") < F.size("words"))).withColumn("w", F.try_element_at("words", F.col("x.i") + 1))
    w = w.where((F.col("w.s") >= 0) & (F.col("w.e") <= F.length("src")) & (F.col("w.s") < F.col("w.e"))).withColumn("s", T.fold_letters(F.substring("src", F.col("w.s") + 1, F.col("w.e") - F.col("w.s"))))
    return w.select(*keys, "chunk", "x.own", "s", "t").where(F.when(F.col("own"), F.length("s") >= 3).otherwise(F.col("s") != ""))


def evidence(words: DataFrame, lex: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """words: of chunk_words; by: columns of both that tell the lexicon. One row a chunk: covered (the lexicon knows one of its words),
    supported (and has the fragment for it), near (it has the fragment for a word before or behind); and the label of that."""
    known = lex.groupBy(*by, F.col("s").alias("form")).agg(F.collect_set("t").alias("ts"))  # at most `top` targets a word
    forms = words.withColumn("form", F.explode(F.array_union(F.array("s"), T.stem_variants("s"))))
    hit = forms.join(known, [*by, "form"], "left")
    fits = F.coalesce(F.exists("ts", lambda x: T.prefix_plausible(x, F.col("t"))), F.lit(False))
    per = hit.groupBy(*keys, "chunk").agg(F.max(F.col("own") & F.col("ts").isNotNull()).alias("covered"), F.max(F.col("own") & fits).alias("supported"), F.max(~F.col("own") & fits).alias("near"))
    return per.withColumn("label", F.when(~F.col("covered"), "no-evidence").when(F.col("supported"), "supported").when(F.col("near"), "fits-neighbour").otherwise("unsupported"))


def checked(words: DataFrame, lex: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """As evidence, counted by answer: covered, supported, and shift hits, which fit the word before or behind and not their own;
    ``reason`` is low-support, else shift-pattern, else null."""
    per = evidence(words, lex, keys, by)
    out = per.groupBy(*keys).agg(F.count_if("covered").alias("n_covered"), F.count_if(F.col("covered") & F.col("supported")).alias("n_supported"), F.count_if(F.col("covered") & ~F.col("supported") & F.col("near")).alias("n_shift_hits"))
    return out.withColumn("reason", F.when(low_support(0.34), "low-support").when(F.col("n_shift_hits") >= 2, "shift-pattern"))


def low_support(most: float | Column) -> Column:
    return (F.col("n_covered") >= 4) & (F.col("n_supported") <= most * F.col("n_covered"))


def clipped_spans(spans: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """spans: key, s, e, k. sents: key, sent_idx, b, f (its range). Spans cut to each sentence they meet, in its offsets."""
    both = spans.join(sents, key).where((F.col("s") < F.col("f")) & (F.col("b") < F.col("e")))
    return both.select(key, "sent_idx", (F.greatest("s", "b") - F.col("b")).alias("s"), (F.least("e", "f") - F.col("b")).alias("e"), "k")


def marks_to_sentences(marks: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """marks: key, pos, id. Each mark to the first sentence that ends at or behind it, else to the last one."""
    both = marks.join(sents, key)
    pick = F.coalesce(F.min(F.when(F.col("f") >= F.col("pos"), F.struct("f", "sent_idx", "b"))), F.max(F.struct("f", "sent_idx", "b")))
    return both.groupBy(key, "pos", "id").agg(pick.alias("x")).select(key, "id", F.col("x.sent_idx").alias("sent_idx"), F.greatest(F.least(F.col("pos"), F.col("x.f")) - F.col("x.b"), F.lit(0)).alias("p"))


def sign_test(k: int, n: int) -> float:
    """Two-sided binomial sign test."""
    if n == 0:
        return 1.0
    tail = sum(comb(n, i) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail / 2**n)


def numbered(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Global places from 0 without one task holding all rows: ranges, their counts, and places inside each range."""
    parts = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    base = parts.groupBy("_pid").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return parts.withColumn("_at", inside).join(F.broadcast(base), "_pid").withColumn(name, F.col("_base") + F.col("_at")).drop("_pid", "_n", "_base", "_at")


def stride_sample(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every step-th row in reading order with step = max(1, n/most), at most ``most`` rows."""
    step = max(1, df.count() // most)
    return numbered(df, order, "_pos").where((F.col("_pos") % step == 0) & (F.col("_pos") < step * most)).drop("_pos")


def clean_sample(df: DataFrame, by: str, share: int = 20) -> DataFrame:
    """A deterministic sample of ceil(n/share) rows: the least by SHA-256 of the text, by places in ranges of the hash."""
    n = df.count()
    at = numbered(df.withColumn("_hash", F.sha2(F.col(by), 256)), ["_hash", by], "_pos")
    return at.where(F.col("_pos") < -(-n // share)).drop("_hash", "_pos")


def sentence_ranges(paras: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, sent_idx, b, f: where the sentences of a text lie by the mark-blank-capital rule, the blanks between with the one before."""
    pieces = F.split(F.regexp_replace(F.col(text), T.SPLIT, f"$1 {T.SEP}$2"), T.SEP)
    p = paras.select(key, F.transform(pieces, F.length).alias("_n"))
    ends = F.transform("_n", lambda n, i: F.aggregate(F.slice("_n", 1, i + 1), F.lit(0), lambda a, x: a + x))
    p = p.select(key, F.posexplode(F.arrays_zip(F.col("_n").alias("n"), ends.alias("f"))).alias("sent_idx", "x"))
    return p.select(key, "sent_idx", (F.col("x.f") - F.col("x.n")).alias("b"), F.col("x.f").alias("f"))

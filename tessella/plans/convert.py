"""Books to bilingual archives: parse, segment, pass by pass over what is missing, fill, validate, write.

Every pass reads and writes a keyed store in shared storage, so a run goes on where one was lost, and another language only adds
its own work. Keys tell source, target, model, glossary and proofreading apart; what is pending is computed by the same keys that
fill reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import corpus as C
from tessella.operators import passes as P
from tessella.session import cut
from tessella.sources import books as B
from tessella.sources import files as S


@dataclass
class Options:
    """Languages, providers by pass (None: the pass is left out) and their batches, and where results are kept."""

    source: str
    target: str
    store: str
    translate: Callable
    align: Callable | None = None
    proofread: Callable | None = None
    judge: Callable | None = None
    terms: Callable | None = None
    model: str = "stand-in"
    batch: int = 16
    rounds: int = 3
    context: int = 0
    limit_chapters: int | None = None
    skip_citations: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.context == 1 or self.context < 0:
            raise ValueError("a context is 0 or at least 2")


def sentences_of_books(paragraphs: DataFrame, limit_chapters: int | None = None) -> DataFrame:
    """Paragraph rows of read_epub or read_fb2 to sentence rows: path, title, author, ch_idx, chapter, para_idx, role, sent_idx, src,
    words. Chapters are limited after the parse; rows of errors go."""
    p = paragraphs.where("error is null and trim(coalesce(text, '')) <> ''")
    if limit_chapters is not None:
        p = p.where(F.col("ch_idx") < limit_chapters)
    p = p.withColumn("_c", F.coalesce(F.col("cell.r") * 10_000 + F.col("cell.c"), F.lit(0))) if "cell" in p.columns else p.withColumn("_c", F.lit(0))
    whole = F.col("role").isin("heading", "subtitle")  # headings are one sentence
    pieces = F.when(whole, F.array(T.clean("text"))).otherwise(T.ruled_sentences("text", F.col("language")))
    s = p.select("path", "title", "author", "ch_idx", "chapter", "para_idx", "_c", "role", F.posexplode(pieces).alias("_i", "src")).where("src <> ''")
    return s.select("path", "title", "author", "ch_idx", "chapter", "para_idx", "role", (F.col("_c") * 10_000 + F.col("_i")).cast("bigint").alias("sent_idx"), "src", T.offsets("src").alias("words"))


def estimate(sentences: DataFrame) -> DataFrame:
    """One row a book: chapters, sentences, words and characters, without any pass."""
    return sentences.groupBy("path", "title", "author").agg(F.countDistinct("ch_idx").alias("n_chapters"), F.count("*").alias("n_sentences"), F.sum(F.size("words").cast("long")).alias("n_words"), F.sum(F.length("src").cast("long")).alias("n_chars"))


def _keys(o: Options, glossary: list[tuple[str, str]]):
    raw = P.model_component(o.model, P.glossary_hash(glossary))
    final = P.model_component(raw, repaired=o.proofread is not None, context=o.context)
    key = lambda version, model: T.key(version, model, o.source, o.target, F.col("src"))
    return {"raw": key("raw", raw), "proofread": key("proofread", raw + (f":c{o.context}" if o.context else "")), "final": key("final", final)}


def run(spark: SparkSession, sentences: DataFrame, o: Options) -> dict[str, DataFrame]:
    """All passes of one target over the sentences' distinct sources. Returns filled (path … src, words, text, align, q, level), verdicts
    and glossary."""
    order = ["path", "ch_idx", "para_idx", "sent_idx"]
    terms = spark.createDataFrame([], "src string, tgt string")
    if o.terms:
        terms = P.glossary(C.stride_sample(sentences.select(*order, "src"), order, 200).select("src"), o.terms)
    keys = _keys(o, [(r.src, r.tgt) for r in terms.collect()])
    wanted = cut(sentences.groupBy("src").agg(F.first("words").alias("words")).select("src", "words", *[k.alias(f"{n}_key") for n, k in keys.items()]))

    # translate what is missing, in rounds
    todo = wanted.select(F.col("raw_key").alias("key"), "src")
    known = S.read_store(spark, o.store).select("key", "text").join(todo.select("key"), "key", "left_semi")
    raw = P.run_rounds(todo, known, o.translate, o.rounds, o.batch)
    S.upsert(spark, o.store, _row(raw.join(known.where(~T.is_artifact("text")).select("key"), "key", "left_anti")))
    texts = raw

    if o.proofread:
        own = wanted.join(raw.withColumnRenamed("key", "raw_key"), "raw_key").select("src", "raw_key", F.col("proofread_key").alias("key"), "text")
        done = S.read_store(spark, o.store).select("key", "text").join(own.select("key"), "key", "left_semi")
        ask = own.join(done.select("key"), "key", "left_anti")
        if o.context:
            first = sentences.groupBy("src").agg(F.min(F.struct(*order)).alias("at")).select("src", "at.*").join(own.select("src", F.col("text").alias("tr")), "src", "left")
            ctx = C.previous_context(first, ["path"], order[1:], o.context, "src", "tr").select("src", "context")
            ask = ask.join(ctx, "src", "left")
        else:
            ask = ask.withColumn("context", F.array().cast("array<struct<src:string,tr:string>>"))
        fixed = cut(P.run_proofread(ask, o.proofread, o.batch))
        both = done.unionByName(fixed)
        texts = P.frozen(own.select("key", "text"), both)
        S.upsert(spark, o.store, _row(texts.join(done.select("key"), "key", "left_anti")))
        texts = texts.join(own.select("key", "raw_key"), "key").select(F.col("raw_key").alias("key"), "text")

    work = wanted.join(texts.withColumnRenamed("key", "raw_key"), "raw_key").select(F.col("final_key").alias("key"), "src", "words", T.restore_list_mark("src", "text").alias("text"))
    final = S.read_store(spark, o.store).join(work.select("key"), "key", "left_semi")
    if o.align:
        ask = work.join(final.select("key"), "key", "left_anti")
        got = cut(P.run_align(ask, o.align, max(1, o.batch // 4)).join(ask.select("key", "text"), "key"))
        S.upsert(spark, o.store, got.select("key", "text", "align", "q"))
        final = S.read_store(spark, o.store).join(work.select("key"), "key", "left_semi")
    out = {"glossary": terms, "filled": _filled(sentences, wanted, final, work)}
    if o.judge:
        from tessella.operators.quality import align_pairs

        f = out["filled"].where("text <> ''")
        pairs = align_pairs(F.col("src"), F.col("words"), F.col("text"), F.col("align"))
        asked = f.select("src", "text", pairs.alias("pairs")).withColumn("key", T.key("j1", o.model, o.source, o.target, F.col("src"), F.col("text"), F.to_json(F.struct("pairs")))).dropDuplicates(["key"])
        place = f"{o.store}-verdicts"
        kept = S.read_store(spark, place, S.VERDICTS)
        new = cut(P.run_judge(asked.join(kept.select("key"), "key", "left_anti"), o.judge, o.batch))
        S.upsert(spark, place, new, S.VERDICTS)
        out["verdicts"] = asked.select("key", "src").join(S.read_store(spark, place, S.VERDICTS), "key", "left")
    return out


def _row(texts: DataFrame) -> DataFrame:
    return texts.select("key", "text", F.lit(None).cast("array<struct<t0:int,t1:int,w:array<int>>>").alias("align"), F.lit(None).cast("double").alias("q"))


def _filled(sentences: DataFrame, wanted: DataFrame, final: DataFrame, work: DataFrame) -> DataFrame:
    """The aligned text, else the text alone, else nothing, by sentence."""
    per = wanted.select("src", F.col("final_key").alias("key")).join(work.select("key", F.col("text").alias("_r")), "key", "left").join(final.select("key", F.col("text").alias("_f"), "align", "q"), "key", "left")
    per = C.levels(per).select("src", "text", F.coalesce("align", F.array().cast("array<struct<t0:int,t1:int,w:array<int>>>")).alias("align"), F.coalesce("q", F.lit(0.0)).alias("q"), "level")
    return sentences.join(per, "src", "left")


def outcome(filled: DataFrame) -> DataFrame:
    """One row a book: sentences, empty ones, unaligned ones, offset errors, and 'complete', 'untranslated' or 'problem'."""
    n = F.size("words")
    bad = F.size(F.filter("align", lambda c: (c["t0"] < 0) | (c["t0"] > c["t1"]) | (c["t1"] > F.length("text")) | F.exists(c["w"], lambda i: (i < 0) | (i >= n))))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    per = filled.groupBy("path").agg(F.count("*").alias("n_sentences"), F.count_if(empty).alias("n_empty"), F.count_if(~empty & (F.size("align") == 0)).alias("n_unaligned"), F.sum(bad.cast("long")).alias("n_offset_errors"))
    return per.withColumn("outcome", F.when(F.col("n_offset_errors") > 0, "problem").when(F.col("n_empty") > 0, "untranslated").otherwise("complete"))


def archives(filled: DataFrame, source: str, target: str, folder: str, old: DataFrame | None = None) -> DataFrame:
    """One archive a book. old: path, ch_idx, para_idx, sent_idx, tr (map of languages) of an earlier archive, whose other languages
    stay."""
    tr = F.struct("text", F.transform("align", lambda c: F.struct(F.array(c["t0"], c["t1"]).alias("t"), c["w"].alias("w"))).alias("align"))
    cols = F.struct("src", F.transform("words", lambda w: F.array(w["s"], w["e"])).alias("words"), F.create_map(F.lit(target), tr).alias("tr"))
    ids = F.xxhash64("path")
    rows = filled.select(ids.alias("book_id"), "title", "author", F.lit(source).alias("source_lang"), F.array(F.lit(target)).alias("targets"), "ch_idx", "chapter", "para_idx", "role", "sent_idx", F.to_json(cols).alias("sentence"))
    return B.write_archives(rows, folder)

"""The queries of the ten training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Sources by chapter and answers by sentence and target, as field, id, g1, g2, text."""
    src = table(spark, d, "sentences").select(F.lit("src").alias("field"), F.col("sentence_id").alias("id"), F.col("book_id").alias("g1"), F.col("ch_idx").cast("string").alias("g2"), F.col("src").alias("text"))
    out = table(spark, d, "translations").select(F.lit("text").alias("field"), F.col("translation_id").alias("id"), F.col("sentence_id").alias("g1"), F.col("target").alias("g2"), "text")
    return src.unionByName(out)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from tessella.llm.normalize import lookalike_pairs

    return lookalike_pairs(_texts(spark, d))


@query
def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its canonical form."""
    from tessella.llm.normalize import canonical_texts

    return canonical_texts(_texts(spark, d)).select("field", F.col("id").alias("row_id"), F.col("canon").alias("canonical_text")).distinct()


@query
def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes behind the pairs: first id, texts and forms of each."""
    from tessella.llm.normalize import lookalike_classes

    return lookalike_classes(_texts(spark, d))


@query
def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, p90, p95 and p99 latency by model and provider, per day (exact) and over all days (from daily summaries)."""
    from tessella.llm.percentiles import measured, percentiles

    rows = measured(table(spark, d, "request_stats"), "latency_ms", ["model", "provider"], "ts", ["req_id", "attempt", "ts", "model", "provider", "latency_ms"])
    out = percentiles(rows, ["model", "provider"])
    return out.select("scope", "model", "provider", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("q").alias("quantile"), F.col("n").alias("n_requests"), F.col("value").alias("latency_ms"), "error_bound")


@query
def p7_daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable daily result behind the totals."""
    from tessella.llm.percentiles import daily_summary, measured

    rows = measured(table(spark, d, "request_stats"), "latency_ms", ["model", "provider"], "ts", ["req_id", "attempt", "ts", "model", "provider", "latency_ms"])
    return daily_summary(rows, ["model", "provider"]).select("model", "provider", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("bucket").alias("bucket_ms"), F.col("n").alias("n_requests"))


_P7_ROWS = """
r AS (SELECT DISTINCT req_id, attempt, ts, nullif(trim(model), '') AS model, nullif(trim(provider), '') AS provider, latency_ms AS v,
             strftime(ts, '%Y-%m-%d') AS day
      FROM request_stats WHERE latency_ms > 0),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket FROM r)"""
ORACLE["p7_percentiles"] = f"""WITH {_P7_ROWS},
q AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile),
dn AS (SELECT *, row_number() OVER (PARTITION BY model, provider, day ORDER BY v) AS rn, count(*) OVER (PARTITION BY model, provider, day) AS n FROM b),
tn AS (SELECT *, row_number() OVER (PARTITION BY model, provider ORDER BY bucket) AS rn, count(*) OVER (PARTITION BY model, provider) AS n FROM b)
SELECT 'day' AS scope, model, provider, day, quantile, n AS n_requests, v::DOUBLE AS latency_ms, 0.0::DOUBLE AS error_bound
FROM dn, q WHERE rn = ceil(round(quantile * n, 6))
UNION ALL
SELECT 'total', model, provider, NULL, quantile, n, bucket + ((1::BIGINT << greatest(length(bin(bucket)) - 8, 0)) - 1) / 2.0::DOUBLE, 1.0::DOUBLE / 256
FROM tn, q WHERE rn = ceil(round(quantile * n, 6))"""
ORACLE["p7_daily_summary"] = f"""WITH {_P7_ROWS}
SELECT model, provider, day, bucket AS bucket_ms, count(*) AS n_requests FROM b GROUP BY ALL"""


def _kinds(spark: SparkSession, d: str) -> dict[str, int]:
    return {r.container_kind: r.capacity_tokens for r in table(spark, d, "containers").collect()}


@query
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """All documents into containers, once for each capacity."""
    from tessella.llm.packing import assign
    from tessella.llm.tokens import with_tokens

    return assign(with_tokens(table(spark, d, "documents").select("doc_id", "text")), _kinds(spark, d))


@query
def p8_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Each document once, in a container of its tier or in a gap of a longer one."""
    from tessella.llm.packing import assign
    from tessella.llm.tokens import with_tokens

    return assign(with_tokens(table(spark, d, "documents").select("doc_id", "text")), _kinds(spark, d), routed=True)


@query
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    cap = table(spark, d, "containers")
    used = p8_pack(spark, d).groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_docs"))
    return used.join(cap, "container_kind").select("container_kind", "n_containers", "n_docs", "tokens", (F.col("tokens") / F.col("n_containers") / F.col("capacity_tokens")).alias("fill"))


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix, with their repeats, in Pfair order."""
    from tessella.llm.mixing import mix
    from tessella.llm.tokens import with_tokens

    return mix(with_tokens(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mix_targets"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each mix."""
    from tessella.llm.mixing import reached

    return reached(p9_mix(spark, d), table(spark, d, "mix_targets"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    from tessella.llm.langid import languages

    return languages(table(spark, d, "sentences"), table(spark, d, "books"), table(spark, d, "documents"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).where("wrong").select("record_kind", "record_id", "line_no", "lang").distinct()


@query
def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """A language with a confidence for every book, document and foreign line."""
    return _languages(spark, d)


def _imported(spark: SparkSession, d: str) -> DataFrame:
    """Sources, titles and authors as field, row_id, value."""
    s = table(spark, d, "sentences").select(F.lit("src").alias("field"), F.col("sentence_id").alias("row_id"), F.col("src").alias("value"))
    books = table(spark, d, "books")
    parts = [books.select(F.lit(c).alias("field"), F.col("book_id").alias("row_id"), F.col(c).alias("value")) for c in ("title", "author")]
    return s.unionByName(parts[0]).unionByName(parts[1])


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from tessella.llm.mojibake import damaged_values

    return damaged_values(_imported(spark, d)).select("field", "row_id").distinct()


@query
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The damaged values and what could be restored."""
    from tessella.llm.mojibake import damaged_values

    return damaged_values(_imported(spark, d)).distinct()


def _defects(spark: SparkSession, d: str, **more) -> DataFrame:
    from tessella.llm.answers import defects

    return defects(table(spark, d, "translations"), table(spark, d, "sentences"), table(spark, d, "books"), **more)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect = 'truncated'").select("translation_id")


def _said(spark: SparkSession, d: str) -> DataFrame:
    """What the last attempt of each request says: req_id, provider, finish_reason."""
    r = table(spark, d, "request_stats").groupBy("req_id").agg(F.max_by(F.struct("provider", "finish_reason"), F.struct("attempt", "logged_at")).alias("r"))
    return r.select("req_id", _label("r.provider").alias("provider"), F.lower("r.finish_reason").alias("finish_reason"))


def _label(c: str):
    return F.nullif(F.trim(F.col(c)), F.lit(""))


@query
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of cut answers by model, provider and target, at a storage limit and elsewhere, beside what finish_reason tells."""
    answers = table(spark, d, "translations").dropDuplicates(["translation_id"]).select("translation_id", "req_id", "model", "target")
    cut = _defects(spark, d).where("defect = 'truncated'").select("translation_id", "cut_by")
    all_ = answers.join(cut, "translation_id", "left").join(_said(spark, d), "req_id", "left")
    told = F.col("finish_reason").isin("length", "max_tokens")
    out = all_.groupBy(_label("model").alias("model"), "provider", "target").agg(F.count("*").alias("n_answers"), F.count("cut_by").alias("n_cut"), F.count_if(F.col("cut_by") == "limit").alias("n_at_limit"), F.count_if(told).alias("n_told"), F.count_if(told & F.col("cut_by").isNotNull()).alias("n_cut_and_told"))
    return out.withColumn("cut_rate", F.col("n_cut") / F.col("n_answers"))


@query
def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """Piles of answers of one length under each encoding, by model, by provider and by target: where a storage limit shows."""
    from tessella.llm.answers import MEASURES, lengths, piles
    from tessella.session import latest

    each = F.array(*[F.struct(F.lit(m).alias("measure"), x.alias("length")) for m, x in enumerate(lengths(F.coalesce(F.col("text"), F.lit(""))))])
    rows = latest(table(spark, d, "translations").select("translation_id", "loaded_at", "req_id", _label("model").alias("model"), "target", each.alias("x")), "translation_id")
    rows = rows.join(_said(spark, d), "req_id", "left").select("model", "provider", "target", F.explode("x").alias("x")).groupBy("model", "provider", "target", "x.measure", "x.length").agg(F.count("*").alias("n"))
    groups = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in ("model", "provider", "target")])).alias("by")
    n = rows.select(groups, "measure", "length", "n").groupBy("by.level", "by.name", "measure", "length").agg(F.sum("n").alias("n"))
    named = F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure") + 1)
    return piles(n, ["level", "name"]).select("level", "name", named.alias("encoding"), "length", F.col("n").alias("n_answers"), F.round("odds", 4).alias("odds"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("translation_id", "defect")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from tessella.llm.pii import personal

    return personal(table(spark, d, "documents")).select("doc_id", "pii_type", "s", "e").distinct()


@query
def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    from tessella.llm.pii import masked

    return masked(table(spark, d, "documents"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    from tessella.llm.sentences import fit, sentence_units

    return sentence_units(table(spark, d, "paragraphs"), fit(table(spark, d, "sentences")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("para_id", "s", "e").distinct()


@query
def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The units in the shape of Sentence: src with the offsets of its words."""
    return _units(spark, d)

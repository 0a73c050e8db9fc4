"""Queries of scoring, judging and the provider passes, and equivalent SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import corpus as C
from tessella.operators import coverage as V
from tessella.operators import passes as P
from tessella.operators import quality as Q
from tessella.plans import catalog as K
from tessella.plans.catalog import ARTIFACT, OFFS, S, TR, W, query
from tessella.session import cut, table

_ANSWERS = f"""{S}, {TR}, {K._TAG}, e AS (SELECT t.translation_id, t.sentence_id, coalesce(bk.tag, '') AS source_lang, coalesce(t.target, '') AS target, t.model, coalesce(src, '') AS src, coalesce(text, '') AS text, coalesce(words, []) AS words, coalesce(align, []) AS align FROM t JOIN s USING (sentence_id) LEFT JOIN bk ON bk.book_id = s.book_id)"""
_MET = "len(list_filter(align, c -> c.t0 < w.e AND w.s < c.t1)) > 0"
_SCORED = f"""{_ANSWERS}, o AS (SELECT *, {OFFS.format('text', W)} AS tw, coalesce({K._STOPMAP}[target], []) AS ts, coalesce({K._STOPMAP}[source_lang], []) AS ss, list_distinct(flatten(list_transform(align, c -> c.w))) AS tap FROM e),
p AS (SELECT *, list_filter(tw, w -> NOT list_contains(ts, lower(substring(text, w.s + 1, w.e - w.s)))) AS tc, list_transform(words, (w, i) -> {{'w': substring(src, w.s + 1, w.e - w.s), 'hit': list_contains(tap, (i - 1)::INT)}}) AS sw FROM o),
sc AS (SELECT *, list_filter(sw, w -> NOT list_contains(ss, lower(w.w))) AS sc FROM p),
sr AS (SELECT translation_id, source_lang, target, model, src, len(sw) AS n_src, CASE WHEN len(tw) > 0 THEN len(list_filter(tw, w -> {_MET})) / len(tw) ELSE -1.0 END AS cov_all, CASE WHEN len(tc) > 0 THEN len(list_filter(tc, w -> {_MET})) / len(tc) ELSE -1.0 END AS cov_content,
CASE WHEN len(sw) > 0 THEN len(list_filter(sw, w -> w.hit)) / len(sw) ELSE -1.0 END AS tap_all, CASE WHEN len(sc) > 0 THEN len(list_filter(sc, w -> w.hit)) / len(sc) ELSE -1.0 END AS tap_content,
array_to_string(list_transform(list_filter(sc, w -> NOT w.hit), w -> w.w), ' ') AS uncovered_src, array_to_string(list_transform(list_filter(tc, w -> NOT ({_MET})), w -> substring(text, w.s + 1, w.e - w.s)), ' ') AS uncovered_tgt FROM sc)"""


def _answers(spark, d):
    books = table(spark, d, "books").select("book_id", F.coalesce(T.language_tag("language"), F.lit("")).alias("source_lang")).dropDuplicates(["book_id"])
    s = K._s(spark, d).select("sentence_id", "book_id", "src", "words").join(books, "book_id", "left").drop("book_id").fillna("", ["source_lang"])
    return K._t(spark, d).select("translation_id", "sentence_id", F.coalesce("target", F.lit("")).alias("target"), "model", "text", "align", "q").join(s, "sentence_id")


@query(f"""WITH {_SCORED} SELECT translation_id, round(cov_all, 6) AS cov_all, round(cov_content, 6) AS cov_content, round(tap_all, 6) AS tap_all, round(tap_content, 6) AS tap_content, uncovered_src, uncovered_tgt FROM sr""")
def sentence_scores(spark, d):
    """Coverage of the answer's and the source's words, all and content ones, and the content words left out."""
    x = Q.scores(_answers(spark, d))
    return x.select("translation_id", *[F.round(c, 6).alias(c) for c in ("cov_all", "cov_content", "tap_all", "tap_content")], *[F.array_join(c, " ").alias(c) for c in ("uncovered_src", "uncovered_tgt")])


@query(f"""WITH {_SCORED} SELECT target, count(*) FILTER (WHERE cov_content >= 0 AND n_src >= 5) AS n, round(avg(CASE WHEN cov_content >= 0 AND n_src >= 5 THEN cov_content END), 6) AS mean_cov, round(list_sort(list(cov_content) FILTER (WHERE cov_content >= 0 AND n_src >= 5))[(count(*) FILTER (WHERE cov_content >= 0 AND n_src >= 5)) // 2 + 1], 6) AS median_cov,
count(*) FILTER (WHERE cov_content >= 0 AND n_src >= 5 AND cov_content < 0.7) AS n_low_cov, count(*) FILTER (WHERE tap_content >= 0 AND n_src >= 5 AND tap_content < 0.8) AS n_low_tap FROM sr GROUP BY target""")
def score_summary(spark, d):
    """Means, upper medians and low shares of content coverage by target, of sources of five words or more."""
    x = Q.scores(_answers(spark, d)).select("target", "cov_content", "tap_content", F.when(F.size("words") >= 5, F.size("words")).alias("n_src"))
    x = cut(x.groupBy("target", "cov_content", "tap_content", F.col("n_src").isNotNull().alias("long")).agg(F.count("*").alias("k")))  # scored once for both uses below
    on = F.col("long") & (F.col("cov_content") >= 0)
    some = lambda c: F.sum(F.when(c, F.col("k")).otherwise(0))
    mean = F.sum(F.when(on, F.col("cov_content") * F.col("k"))) / F.nullif(some(on), F.lit(0))
    flat = x.groupBy("target").agg(some(on).alias("n"), F.round(mean, 6).alias("mean_cov"), some(on & (F.col("cov_content") < 0.7)).alias("n_low_cov"), some(F.col("long") & (F.col("tap_content") >= 0) & (F.col("tap_content") < 0.8)).alias("n_low_tap"))
    med = V.ranked_median(x.where(on), ["target"], "cov_content", "k").select("target", F.round("median", 6).alias("median_cov"))
    return flat.join(med, "target", "left")


_LOCAL = r"""CASE WHEN len(list_filter(align, c -> greatest(c.t0, 0) < least(c.t1, length(text)) AND regexp_matches(substring(text, greatest(c.t0, 0) + 1, least(c.t1, length(text)) - greatest(c.t0, 0)), '[\p{L}\p{Nd}]'))) = 0 THEN 0.0
ELSE len(list_filter(align, c -> greatest(c.t0, 0) < least(c.t1, length(text)) AND regexp_matches(substring(text, greatest(c.t0, 0) + 1, least(c.t1, length(text)) - greatest(c.t0, 0)), '[\p{L}\p{Nd}]') AND len(c.w) > 0)) / len(list_filter(align, c -> greatest(c.t0, 0) < least(c.t1, length(text)) AND regexp_matches(substring(text, greatest(c.t0, 0) + 1, least(c.t1, length(text)) - greatest(c.t0, 0)), '[\p{L}\p{Nd}]'))) END"""


@query(f"""WITH {_ANSWERS} SELECT translation_id, round({_LOCAL}, 6) AS coverage FROM e""")
def chunk_coverage(spark, d):
    """Coverage by chunk, for answers without a stored one."""
    return _answers(spark, d).select("translation_id", F.round(Q.local_coverage(F.coalesce("text", F.lit("")), F.col("align")), 6).alias("coverage"))


_Q = f"""{_ANSWERS}, o AS (SELECT *, {OFFS.format('text', W)} AS tw FROM e), c0 AS (SELECT *, list_filter(tw, w -> NOT list_contains(coalesce({K._STOPMAP}[target], []), lower(substring(text, w.s + 1, w.e - w.s)))) AS c0 FROM o), c1 AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE tw END AS cw FROM c0),
q AS (SELECT translation_id, target, src, len(align) AS n_chunks, CASE WHEN len(tw) > 0 THEN len(list_filter(tw, w -> len(list_filter(align, c -> c.t0 < w.e AND w.s < c.t1 AND len(c.w) > 0)) > 0)) / len(tw) ELSE 0.0 END AS q_all, CASE WHEN len(cw) > 0 THEN len(list_filter(cw, w -> len(list_filter(align, c -> c.t0 < w.e AND w.s < c.t1 AND len(c.w) > 0)) > 0)) / len(cw) ELSE 0.0 END AS q_content FROM c1)"""
# the lexicon's tables beside the coverage: names of the same meaning come once
_LEX = K._CLEAN.replace(f"{S}, {TR}, {K._TAG}, e AS (", "le AS (").replace(" FROM e)", " FROM le)").replace(" FROM e,", " FROM le,").replace("align FROM e)", "align FROM le)")


def _flags(spark, d):
    return K._checked(spark, d).select("translation_id", F.col("reason").isNotNull().alias("flagged"))


@query(f"""WITH {_Q}, {_LEX}, f AS (SELECT translation_id, ({K._REASON}) IS NOT NULL AS flagged FROM su)
SELECT target, count(*) AS n, count(*) FILTER (WHERE q_content < 0.7) AS n_low, count(*) FILTER (WHERE coalesce(flagged, false)) AS n_flagged, count(*) FILTER (WHERE q_content < 0.7 OR coalesce(flagged, false)) AS n_rejected FROM q LEFT JOIN f USING (translation_id) GROUP BY target""")
def hybrid_gate(spark, d):
    """Answers that the hybrid alignment hands on: content coverage below 0.7, or flagged by the lexicon."""
    x = Q.content_q(_answers(spark, d).select("translation_id", "target", "text", "align")).select("translation_id", "target", "q_content").join(_flags(spark, d), "translation_id", "left")
    low, flag = F.col("q_content") < 0.7, F.coalesce("flagged", F.lit(False))
    return x.groupBy("target").agg(F.count("*").alias("n"), F.count_if(low).alias("n_low"), F.count_if(flag).alias("n_flagged"), F.count_if(low | flag).alias("n_rejected"))


_SCOPE = f"""{_ANSWERS}, {_LEX}, f AS (SELECT translation_id, ({K._REASON}) IS NOT NULL AS flagged FROM su), lq AS (SELECT e.translation_id, e.src, CASE WHEN coalesce(tt.q, 0) = 0 THEN {_LOCAL.replace('(text', '(e.text').replace('align', 'e.align')} ELSE tt.q END AS q FROM e JOIN t tt USING (translation_id) WHERE e.text <> ''),
pr AS (SELECT lq.src, bool_or(coalesce(flagged, false)) AS f, min(q) AS q FROM lq LEFT JOIN f USING (translation_id) GROUP BY lq.src),
re AS (SELECT src, row_number() OVER (ORDER BY sha256(src), src) AS k, count(*) OVER () AS n FROM pr WHERE NOT f AND NOT q < 0.7),
jd AS (SELECT src, CASE WHEN f THEN 'flagged' ELSE 'low' END AS why FROM pr WHERE f OR q < 0.7 UNION ALL SELECT src, 'sample' FROM re WHERE k <= ceil(n / 20.0))"""


def _scope(spark, d):
    a = _answers(spark, d).where("coalesce(text, '') <> ''").withColumn("src", F.coalesce("src", F.lit("")))
    q = F.when(F.coalesce("q", F.lit(0.0)) == 0, Q.local_coverage(F.col("text"), F.col("align"))).otherwise(F.col("q"))
    return Q.judge_scope(a.select("translation_id", "src", q.alias("q")).join(_flags(spark, d), "translation_id", "left"))


@query(f"""WITH {_SCOPE} SELECT src, why FROM jd""")
def judge_scope(spark, d):
    """The sources a judge is asked about: flagged, covered too little in any target, or of the sample of the rest."""
    return _scope(spark, d)


@query(f"""WITH {_SCOPE}, v AS (SELECT src, why, left(sha256(src), 1) IN ('0', '1', '2') AS bad FROM jd) SELECT why, count(*) AS n, count(*) FILTER (WHERE bad) AS n_flagged, round(100.0 * count(*) FILTER (WHERE bad) / greatest(1, count(*)), 6) AS rate FROM v GROUP BY why""")
def calibration_rate(spark, d):
    """Flag rates of a made-up judge in the sample of the clean rest, beside the suspects."""
    bad = F.substring(F.sha2("src", 256), 1, 1).isin("0", "1", "2")
    out = _scope(spark, d).groupBy("why").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_flagged"))
    return out.withColumn("rate", F.round(100.0 * F.col("n_flagged") / F.greatest(F.lit(1), F.col("n")), 6))


@query(f"""WITH {_Q}, {K._CLEAN.replace(f"{S}, {TR}, {K._TAG}, e AS (", "le AS (").replace(" FROM e)", " FROM le)").replace(" FROM e,", " FROM le,").replace("al AS (SELECT translation_id, 'clean' AS kind, source_lang, target, src, text, words, align FROM le)", f"al AS (SELECT translation_id, 'all' AS kind, source_lang, target, src, text, words, align FROM le UNION ALL SELECT translation_id, 'content', source_lang, target, src, text, words, list_filter(align, c -> c.t0 >= 0 AND c.t1 <= length(text) AND c.t0 < c.t1 AND NOT list_contains(coalesce({K._STOPMAP}[target], []), lower(substring(text, c.t0 + 1, c.t1 - c.t0)))) FROM le)")},
l AS (SELECT target, sum(CASE WHEN kind = 'all' THEN n_covered END)::BIGINT AS n_scored, sum(CASE WHEN kind = 'all' THEN n_supported END)::BIGINT AS n_supported, sum(CASE WHEN kind = 'content' THEN n_covered END)::BIGINT AS n_scored_content, sum(CASE WHEN kind = 'content' THEN n_supported END)::BIGINT AS n_supported_content, count(*) FILTER (WHERE kind = 'all' AND ({K._REASON}) IS NOT NULL) AS n_flagged FROM su GROUP BY target),
b AS (SELECT target, count(*) AS n, round(avg(q_all), 6) AS mean_q, round(list_sort(list(q_all))[count(*) // 2 + 1], 6) AS median_q, round(avg(q_content), 6) AS mean_content, round(list_sort(list(q_content))[count(*) // 2 + 1], 6) AS median_content, count(*) FILTER (WHERE q_content < 0.7) AS n_gated, round(sum(n_chunks) / greatest(1, count(*)), 6) AS chunks_each FROM q GROUP BY target)
SELECT b.*, coalesce(n_scored, 0) AS n_scored, coalesce(n_supported, 0) AS n_supported, coalesce(n_scored_content, 0) AS n_scored_content, coalesce(n_supported_content, 0) AS n_supported_content, coalesce(n_flagged, 0) AS n_flagged FROM b LEFT JOIN l USING (target)""".replace("b AS (SELECT book_id", "bb AS (SELECT book_id").replace("FROM b),", "FROM bb),", 1))
def alignment_bench(spark, d):
    """Totals of the stored alignments by target: coverage, gate, chunks, and the lexicon's support of all and of content chunks."""
    a = _answers(spark, d)
    q = Q.content_q(a.select("translation_id", "target", "text", "align"))
    q = cut(q.select("target", "q_all", "q_content", F.size(F.coalesce("align", F.array().cast(Q.ALIGN))).alias("n_chunks")))  # used three times below
    per = q.groupBy("target").agg(F.count("*").alias("n"), F.round(F.avg("q_all"), 6).alias("mean_q"), F.round(F.avg("q_content"), 6).alias("mean_content"), F.count_if(F.col("q_content") < 0.7).alias("n_gated"), F.round(F.sum("n_chunks") / F.count("*"), 6).alias("chunks_each"))
    for c, name in (("q_all", "median_q"), ("q_content", "median_content")):
        per = per.join(V.ranked_median(q, ["target"], c).select("target", F.round("median", 6).alias(name)), "target", "left")
    both, words = K._all_answers(spark, d)
    align = F.col("align")
    kinds = F.array(F.struct(F.lit("all").alias("kind"), align.alias("align")), F.struct(F.lit("content").alias("kind"), Q.content_chunks(F.col("text"), align, F.col("target")).alias("align")))
    keys = ["translation_id", "kind", *K._PAIR]
    rows = both.select("translation_id", *K._PAIR, "src", "text", "words", F.explode(kinds).alias("x")).select("translation_id", *K._PAIR, "src", "text", "words", "x.kind", F.col("x.align").alias("align"))
    lex = C.checked(C.chunk_words(rows, F.col("align"), keys), C.lexicon_of(words, by=K._PAIR), keys, K._PAIR)
    of = lambda c, kind: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    sums = lex.groupBy("target").agg(of("n_covered", "all").alias("n_scored"), of("n_supported", "all").alias("n_supported"), of("n_covered", "content").alias("n_scored_content"), of("n_supported", "content").alias("n_supported_content"), F.count_if((F.col("kind") == "all") & F.col("reason").isNotNull()).alias("n_flagged"))
    return per.join(sums, "target", "left").fillna(0, ["n_scored", "n_supported", "n_scored_content", "n_supported_content", "n_flagged"])


@query()
def expression_probes(spark, d):
    """The first two words of every source as an expression: how its rendering stands together in each answer, by target."""
    a = _answers(spark, d).where(F.size("words") >= 2)
    two = F.substring("src", F.col("words")[0]["s"] + 1, F.col("words")[1]["e"] - F.col("words")[0]["s"])
    return Q.probes(a.withColumn("expr", two)).groupBy("target", "verdict").agg(F.count("*").alias("n"))


# --- scalars
@query(r"""SELECT book_id, regexp_replace(file_name, '(?i)\.(fb2\.zip|fb2|epub)$', '') AS stem FROM books WHERE file_name IS NOT NULL""")
def book_stems(spark, d):
    return table(spark, d, "books").where("file_name is not null").select("book_id", T.book_stem("file_name").alias("stem"))


_WS = r"[\s\p{Z}\x{85}\x{0b}]+"
_PLACE = lambda at: f"least(length(regexp_replace(regexp_replace(substring(text, 1, {at}), '^{_WS}', ''), '{_WS}', ' ', 'g')), length({K.CLEAN.format('text')}))"


@query(f"""WITH sp AS (SELECT para_id, text, unnest(spans) AS x FROM paragraphs WHERE text IS NOT NULL), m AS (SELECT para_id, x.k AS k, {_PLACE('x.s')} AS s, {_PLACE('x.e')} AS e FROM sp) SELECT para_id, k, s::INT AS s, e::INT AS e FROM m WHERE s < e""")
def clean_spans(spark, d):
    """The spans of raw paragraphs in the offsets of the cleaned text; empty ones go."""
    x = table(spark, d, "paragraphs").where("text is not null").select("para_id", "text", F.explode("spans").alias("x"))
    return x.select("para_id", F.col("x.k").alias("k"), T.clean_place("text", F.col("x.s")).alias("s"), T.clean_place("text", F.col("x.e")).alias("e")).where("s < e")


@query(r"""WITH x AS (SELECT translation_id, text, length(regexp_extract(text, '^[.,:;)\]* ]+')) AS n FROM (SELECT *, row_number() OVER (PARTITION BY translation_id ORDER BY loaded_at DESC NULLS LAST) AS rn_ FROM translations) WHERE rn_ = 1 AND text IS NOT NULL) SELECT translation_id, n::INT AS n_trimmed, substring(text, n + 1) AS trimmed FROM x WHERE n > 0""")
def leading_marks_trimmed(spark, d):
    x = K._t(spark, d).where("text is not null").select("translation_id", T.leading_marks("text").alias("n_trimmed"), T.without_leading_marks("text").alias("trimmed"))
    return x.where("n_trimmed > 0")


@query(r"""SELECT req_id, attempt, status IN (400, 401, 402, 403, 404) AS permanent, coalesce(regexp_matches(err, '(?i)(usage limit|session limit|hit your .{0,20}limit|limit reached)'), false) AS exhausted, TRY_CAST(nullif(regexp_extract(err, '\|([0-9]{10})\b', 1), '') AS BIGINT) AS reset_at FROM (SELECT DISTINCT req_id, attempt, status, err FROM request_stats WHERE status <> 200)""")
def error_classes(spark, d):
    """Failed requests: whether a retry may help, and an exhausted quota with its end."""
    r = table(spark, d, "request_stats").where("status <> 200").select("req_id", "attempt", "status", "err").distinct()
    return r.select("req_id", "attempt", T.is_permanent("status").alias("permanent"), T.is_exhausted("err").alias("exhausted"), T.reset_at("err").alias("reset_at"))


# --- groups, sets, samples
@query(f"""WITH {S}, k AS (SELECT CASE WHEN kind = 'citation' THEN 'citation' WHEN kind = 'note' THEN 'note' ELSE 'prose' END AS kind, src FROM s)
SELECT kind, count(*) AS n, count(DISTINCT src) AS n_unique, kind <> 'citation' AS translated FROM k GROUP BY kind""")
def sentence_groups(spark, d):
    """The flat sentences in their three groups, and which are translated when citations are left."""
    kind = F.when(F.col("kind") == "citation", "citation").when(F.col("kind") == "note", "note").otherwise("prose")
    return K._s(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_unique")).withColumn("translated", F.col("kind") != "citation")


@query(f"""WITH {S}, c AS (SELECT DISTINCT book_id, ch_idx FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ch_idx) AS k FROM c) SELECT book_id, count(*) AS n_sentences FROM s JOIN r USING (book_id, ch_idx) WHERE k <= 3 GROUP BY book_id""")
def first_chapters(spark, d):
    """Sentences of the first three chapters of each book."""
    s = K._s(spark, d).select("book_id", "ch_idx")
    c = s.groupBy("book_id", "ch_idx").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("book_id").orderBy("ch_idx"))
    return c.withColumn("k", at).where("k <= 3").groupBy("book_id").agg(F.sum("n").alias("n_sentences"))


_TWO = f"""{S}, {TR}, p AS (SELECT sentence_id, target, min(translation_id) AS a, max(translation_id) AS b FROM t WHERE target IS NOT NULL GROUP BY ALL), x AS (SELECT p.sentence_id, p.target, s.src, trim(coalesce(ta.text, '')) AS before, trim(coalesce(tb.text, '')) AS after, a <> b AS two FROM p JOIN t ta ON ta.translation_id = a JOIN t tb ON tb.translation_id = b JOIN s ON s.sentence_id = p.sentence_id)"""


def _two(spark, d):
    """The first and the last answer of a sentence and target, as a text before and after."""
    t = K._t(spark, d).where("target is not null").groupBy("sentence_id", "target").agg(F.min_by("text", "translation_id").alias("a"), F.max_by("text", "translation_id").alias("b"), F.count("*").alias("n"))
    x = t.join(K._s(spark, d).select("sentence_id", "src"), "sentence_id")
    return x.select("sentence_id", "target", "src", F.trim(F.coalesce("a", F.lit(""))).alias("before"), F.trim(F.coalesce("b", F.lit(""))).alias("after"), (F.col("n") > 1).alias("two"))


@query(f"""WITH {_TWO} SELECT target, count(*) FILTER (WHERE two AND after <> '' AND after <> before) AS n_changed, count(*) FILTER (WHERE two AND after <> '' AND after = before) AS n_unchanged, count(*) FILTER (WHERE NOT two OR after = '') AS n_kept FROM x GROUP BY target""")
def proofread_counts(spark, d):
    """Of a later answer as the proofread text: changed, unchanged, and kept where there is none."""
    new = F.col("two") & (F.col("after") != "")
    return _two(spark, d).groupBy("target").agg(F.count_if(new & (F.col("after") != F.col("before"))).alias("n_changed"), F.count_if(new & (F.col("after") == F.col("before"))).alias("n_unchanged"), F.count_if(~new).alias("n_kept"))


@query(f"""WITH {_TWO}, c AS (SELECT sentence_id, target, src, before, after, sha256(sentence_id::VARCHAR || target) AS h FROM x WHERE two AND before <> after AND before <> '' AND after <> '' AND len(regexp_extract_all(src, '\\S+')) >= 6),
r AS (SELECT *, row_number() OVER (ORDER BY h, sentence_id, target) - 1 AS pos FROM c) SELECT sentence_id, target, pos // 10 AS batch, left(h, 1) < '8' AS swapped, CASE WHEN left(h, 1) < '8' THEN after ELSE before END AS x, CASE WHEN left(h, 1) < '8' THEN before ELSE after END AS y FROM r""")
def judging_batches(spark, d):
    """Pairs of different answers in batches of ten, in an order and with a swap that a hash decides."""
    x = _two(spark, d).where(F.col("two") & (F.col("before") != F.col("after")) & (F.col("before") != "") & (F.col("after") != "") & (F.size(F.regexp_extract_all("src", F.lit(r"(\S+)"), F.lit(1))) >= 6))
    x = C.numbered(x.withColumn("h", F.sha2(F.concat(F.col("sentence_id").cast("string"), "target"), 256)), ["h", "sentence_id", "target"], "at")
    swap = F.substring("h", 1, 1) < "8"
    return x.select("sentence_id", "target", F.floor(F.col("at") / 10).alias("batch"), swap.alias("swapped"), F.when(swap, F.col("after")).otherwise(F.col("before")).alias("x"), F.when(swap, F.col("before")).otherwise(F.col("after")).alias("y"))


@query(f"""WITH {S}, {TR}, v AS (SELECT trim(src) AS src, t.model, t.target, trim(coalesce(text, '')) AS text, row_number() OVER (PARTITION BY t.model, t.target, trim(src) ORDER BY s.book_id DESC, ch_idx DESC, para_idx DESC, sent_idx DESC, t.translation_id DESC) AS k FROM t JOIN s USING (sentence_id) WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(src, '')) <> '' AND t.model IN ('orbit-large', 'orbit-mini')),
l AS (SELECT * FROM v WHERE k = 1) SELECT a.target, count(*) AS n_common, count(*) FILTER (WHERE a.text = b.text) AS n_same, count(*) FILTER (WHERE a.text <> b.text) AS n_differ FROM l a JOIN l b ON a.src = b.src AND a.target = b.target WHERE a.model = 'orbit-large' AND b.model = 'orbit-mini' GROUP BY a.target""")
def common_texts(spark, d):
    """Sources that two models answered, the last occurrence of each: same and different texts by target."""
    s = K._s(spark, d).where("trim(coalesce(src, '')) <> ''").select("sentence_id", F.trim("src").alias("src"), F.struct("book_id", "ch_idx", "para_idx", "sent_idx").alias("at"))
    t = K._t(spark, d).where(F.col("model").isin("orbit-large", "orbit-mini") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("translation_id", "sentence_id", "model", "target", F.trim("text").alias("text"))
    l = t.join(s, "sentence_id").groupBy("target", "src").agg(*[F.max_by(F.when(F.col("model") == m, F.col("text")), F.when(F.col("model") == m, F.struct("at", "translation_id"))).alias(c) for m, c in (("orbit-large", "a"), ("orbit-mini", "b"))])
    return l.where("a is not null and b is not null and target is not null").groupBy("target").agg(F.count("*").alias("n_common"), F.count_if(F.col("a") == F.col("b")).alias("n_same"), F.count_if(F.col("a") != F.col("b")).alias("n_differ"))


# --- passes
@query(f"""WITH {S}, {TR}, k AS (SELECT sentence_id, target, max(CASE WHEN len(coalesce(align, [])) > 0 AND trim(coalesce(text, '')) <> '' THEN text END) AS fin, max(CASE WHEN trim(coalesce(text, '')) <> '' THEN text END) AS raw, max(CASE WHEN q >= 0.8 THEN text END) AS rp FROM t WHERE target IS NOT NULL GROUP BY ALL),
w AS (SELECT target, src, max(fin) AS fin, max(raw) AS raw, max(rp) AS rp FROM (SELECT tg.target, s.src, k.fin, k.raw, k.rp FROM s CROSS JOIN (SELECT DISTINCT target FROM k) tg LEFT JOIN k ON k.sentence_id = s.sentence_id AND k.target = tg.target WHERE src IS NOT NULL) GROUP BY ALL)
SELECT target, CASE WHEN fin IS NOT NULL AND NOT regexp_matches(fin, '{ARTIFACT}') THEN 'done' WHEN raw IS NULL OR regexp_matches(raw, '{ARTIFACT}') THEN 'translate' WHEN rp IS NULL THEN 'proofread' ELSE 'align' END AS phase, count(*) AS n FROM w GROUP BY ALL""")
def pending_phases(spark, d):
    """Which pass each source and target waits for: stored final, raw and proofread texts in their namespaces."""
    some = lambda c, cond: F.max(F.when(cond, F.col(c)))
    there = F.trim(F.coalesce("text", F.lit(""))) != ""
    k = K._t(spark, d).where("target is not null").groupBy("sentence_id", "target").agg(some("text", there & (F.size(F.coalesce("align", F.array().cast(Q.ALIGN))) > 0)).alias("final"), some("text", there).alias("raw"), some("text", F.col("q") >= 0.8).alias("proofread"))
    s = K._s(spark, d).where("src is not null").select("sentence_id", "src")
    targets = [r.target for r in k.select("target").distinct().collect()]  # a handful
    w = s.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).join(k, ["sentence_id", "target"], "left") if targets else s.limit(0).withColumn("target", F.lit("")).join(k, ["sentence_id", "target"], "left")
    w = w.groupBy("target", "src").agg(F.max("final").alias("final"), F.max("raw").alias("raw"), F.max("proofread").alias("proofread"))
    return w.groupBy("target", P.phase(F.col("final"), F.col("raw"), F.col("proofread")).alias("phase")).agg(F.count("*").alias("n"))


@query()
def align_pass(spark, d):
    """Every distinct source through the translate and the align pass of a stand-in provider: fragments located in the text,
    echoed words resolved to numbers."""
    wanted = K._s(spark, d).where((F.trim("src") != "") & ~T.is_artifact("src")).select(T.key(F.col("src")).alias("key"), "src").dropDuplicates(["key"]).withColumn("words", T.offsets("src"))
    text = P.run_pass(wanted, P.tagging_provider("xx"))
    out = P.run_align(wanted.join(text, "key"), P.echoing_aligner())
    return out.select("key", F.size("align").alias("n_chunks"), F.array_join(F.transform("align", lambda c: F.concat(c["t0"].cast("string"), F.lit("-"), c["t1"].cast("string"), F.lit("="), F.array_join(c["w"].cast("array<string>"), ","))), " ").alias("align"))


@query(f"""WITH {_ANSWERS}, j AS (SELECT DISTINCT source_lang, target, src, text, list_transform(list_filter(align, c -> greatest(c.t0, 0) < least(c.t1, length(text))), c -> [substring(text, greatest(c.t0, 0) + 1, least(c.t1, length(text)) - greatest(c.t0, 0)),
array_to_string(list_transform(list_filter(c.w, i -> i >= 0 AND i < len(words) AND words[i + 1].s >= 0 AND words[i + 1].e <= length(src) AND words[i + 1].s < words[i + 1].e), i -> substring(src, words[i + 1].s + 1, words[i + 1].e - words[i + 1].s)), ' ')]) AS pairs FROM e WHERE text <> '')
SELECT target, count(*) AS n_checked, count(*) FILTER (WHERE length(text) * 3 < length(src)) AS n_flagged, 0::BIGINT AS n_unjudged, count(DISTINCT CASE WHEN length(text) * 3 < length(src) THEN src END) AS n_flagged_srcs FROM j GROUP BY target""")
def judge_pass(spark, d):
    """Every different answer through the judge pass of a stand-in provider, kept by content key, and the tally by target."""
    a = _answers(spark, d).where("coalesce(text, '') <> ''").withColumn("src", F.coalesce("src", F.lit("")))
    pairs = Q.align_pairs(F.col("src"), F.coalesce("words", F.array().cast(Q.WORDS)), F.col("text"), F.coalesce("align", F.array().cast(Q.ALIGN)))
    key = T.key("j1", "stand-in", F.col("source_lang"), F.col("target"), F.col("src"), F.col("text"), F.to_json(F.struct(pairs.alias("p"))))
    asked = a.select(key.alias("key"), "src", "target", "text", pairs.alias("pairs")).dropDuplicates(["key"])
    verdicts = P.run_judge(asked, P.length_judge())
    out = asked.select("key", "src", "target").join(verdicts, "key", "left")
    bad = F.coalesce(~F.col("ok"), F.lit(False))
    return out.groupBy("target").agg(F.count("*").alias("n_checked"), F.count_if(bad).alias("n_flagged"), F.count_if(F.col("ok").isNull()).alias("n_unjudged"), F.countDistinct(F.when(bad, F.col("src"))).alias("n_flagged_srcs"))


@query(f"""WITH {S}, o AS (SELECT src, row_number() OVER (ORDER BY book_id, ch_idx, para_idx, sent_idx, sentence_id) - 1 AS pos, count(*) OVER () AS n FROM s WHERE src IS NOT NULL), p AS (SELECT src FROM o WHERE pos % greatest(1, n // 200) = 0 AND pos < greatest(1, n // 200) * 200)
SELECT DISTINCT w AS src, '[xx] ' || w AS tgt FROM (SELECT unnest(regexp_extract_all(src, '{W}')) AS w FROM p) WHERE length(w) >= 8""")
def glossary(spark, d):
    """Terms of a sample of 200 sentences in reading order by a stand-in provider: trimmed, blank ones dropped, sorted."""
    s = K._s(spark, d).where("src is not null").select("src", "book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id")
    sample = C.stride_sample(s, ["book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id"], 200).select("src")
    return P.glossary(sample, P.long_words_glossary("xx"))


@query(f"""WITH {S}, {TR}, f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY book_id, ch_idx, para_idx, sent_idx, sentence_id) AS k FROM s WHERE src IS NOT NULL), u AS (SELECT * FROM f WHERE k = 1), x AS (SELECT sentence_id, arg_min(text, translation_id) AS tr FROM t WHERE target = 'de' AND text IS NOT NULL GROUP BY 1),
y AS (SELECT u.sentence_id, u.book_id, u.ch_idx, u.para_idx, u.sent_idx, src, coalesce(tr, '') AS tr FROM u LEFT JOIN x USING (sentence_id))
SELECT sentence_id, coalesce(len(list_filter(c, x -> x.tr <> '')), 0) AS n_context FROM (SELECT sentence_id, list({{'src': src, 'tr': tr}}) OVER (PARTITION BY book_id ORDER BY ch_idx, para_idx, sent_idx, sentence_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS c FROM y)""")
def unique_context(spark, d):
    """The German context of each source's first occurrence, the neighbours being first occurrences too."""
    order = F.struct("book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id")
    u = K._s(spark, d).where("src is not null").groupBy("src").agg(F.min(order).alias("at")).select("src", "at.*")
    x = K._t(spark, d).where("target = 'de' and text is not null").groupBy("sentence_id").agg(F.min_by("text", "translation_id").alias("tr"))
    y = C.previous_context(u.join(x, "sentence_id", "left"), ["book_id"], ["ch_idx", "para_idx", "sent_idx", "sentence_id"], 2, "src", "tr")
    return y.select("sentence_id", F.size("context").alias("n_context"))


@query(f"""WITH {K._EACH}, {K._DRIFT}, {K._CHECKED} SELECT kind, target, CASE WHEN NOT covered THEN 'no-evidence' WHEN supported THEN 'supported' WHEN near THEN 'fits-neighbour' ELSE 'unsupported' END AS label, count(*) AS n FROM hi GROUP BY ALL""")
def evidence_labels(spark, d):
    """What the lexicon says of every chunk, of the alignments as they are and drifted by one word, wholly and in their second half."""
    both, words = K._all_answers(spark, d)
    both = both.where((F.size("align") >= 4) & (F.size("words") >= 5))
    size = F.size("align")
    drifts = F.array(*[F.struct(F.lit(k).alias("kind"), K.A.shifted(F.col("align"), F.size("words"), at).alias("align")) for k, at in {"clean": size, "full": F.lit(0), "half": size - F.floor(size / 2).cast("int")}.items()])
    keys = ["translation_id", "kind", *K._PAIR]
    rows = both.select("translation_id", *K._PAIR, "src", "text", "words", F.explode(drifts).alias("x")).select("translation_id", *K._PAIR, "src", "text", "words", "x.kind", F.col("x.align").alias("align"))
    per = C.evidence(C.chunk_words(rows, F.col("align"), keys), C.lexicon_of(words, by=K._PAIR), keys, K._PAIR)
    return per.groupBy("kind", "target", "label").agg(F.count("*").alias("n"))


@query()
def embedding_alignment(spark, d):
    """Every answer aligned with its source by a stand-in encoder, through the gate, by target."""
    from tessella.operators.encode import embed_align, hashed_encoder

    a = _answers(spark, d).where("text is not null and src is not null").select("translation_id", "target", "src", F.coalesce("words", F.array().cast(Q.WORDS)).alias("words"), "text")
    out = embed_align(a, hashed_encoder, ["translation_id"])
    return out.groupBy("target").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.round(F.avg("q_content"), 6).alias("mean_content"), F.sum(F.size("align").cast("long")).alias("n_chunks"))


@query(f"""WITH {S}, f AS (SELECT src, min(struct_pack(a := book_id, b := ch_idx, c := para_idx, d := sent_idx, e := sentence_id)) AS at FROM s WHERE src IS NOT NULL GROUP BY src HAVING count(*) > 1) SELECT s.sentence_id, s.src FROM s JOIN f ON f.src = s.src WHERE s.book_id <> f.at.a""")
def subset_by_source(spark, d):
    """Sentences of other books whose source is on the list of recurring ones: a subset by a list of sources."""
    s = K._s(spark, d).where("src is not null").select("sentence_id", "src", "book_id", "ch_idx", "para_idx", "sent_idx")
    first = s.groupBy("src").agg(F.min(F.struct("book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id")).alias("at"), F.count("*").alias("n")).where("n > 1")
    return s.join(first.select("src", F.col("at.book_id").alias("first_book")), "src").where("book_id <> first_book").select("sentence_id", "src")


@query("""SELECT para_id, array_to_string(list_transform(marks, m -> m.id || '@' || m.pos::VARCHAR || ':' || coalesce(m.label, '')), ' ') AS refs FROM paragraphs WHERE len(marks) > 0""")
def note_refs(spark, d):
    """The note references of each paragraph."""
    m = table(spark, d, "paragraphs").where(F.size("marks") > 0)
    return m.select("para_id", F.array_join(F.transform("marks", lambda x: F.concat(x["id"], F.lit("@"), x["pos"].cast("string"), F.lit(":"), F.coalesce(x["label"], F.lit("")))), " ").alias("refs"))

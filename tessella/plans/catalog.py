"""All queries of the engine's own operators over the test tables, and equivalent SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import text as T
from tessella.operators import align as A
from tessella.operators import corpus as C
from tessella.operators import coverage as V
from tessella.session import cut, latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            # DuckDB's own lambda syntax
            duck = re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", sql)
            ORACLE[f.__name__] = re.sub(r"\b(\w+) -> ", r"lambda \1: ", duck)
        return f

    return add


def _s(spark, d):
    return latest(table(spark, d, "sentences"), "sentence_id")


def _t(spark, d):
    return latest(table(spark, d, "translations"), "translation_id")


# --- the same pieces in SQL
W = r"\p{L}[\p{L}\p{M}]*(?:[''’-]\p{L}[\p{L}\p{M}]*)*"


class _Sql(str):
    """SQL with places @0, @1 for other SQL."""

    def format(self, *parts: str) -> str:
        out = str(self)
        for i, p in enumerate(parts):
            out = out.replace(f"@{i}", p)
        return out


CLEAN = _Sql(r"trim(regexp_replace(@0, '[\s\p{Z}\x{85}\x{0b}]+', ' ', 'g'))")
UNGLUE = _Sql(CLEAN.format(r"""regexp_replace(@0, '([.!?…]{1,3}["»”’'')\]]?)(\p{Lu})', '\1 \2', 'g')"""))
SENTS = _Sql(r"""string_split(regexp_replace(@0, '([.!?…]["»”’'')\]]*) (["“«‘'']?\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))""")
S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY loaded_at DESC NULLS LAST) AS rn_ FROM sentences) WHERE rn_ = 1)"
TR = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY translation_id ORDER BY loaded_at DESC NULLS LAST) AS rn_ FROM translations) WHERE rn_ = 1)"
LINES = "li AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para_idx FROM documents), " "p AS (SELECT doc_id, lang, para_idx, " + CLEAN.format("l") + " AS text FROM li WHERE " + CLEAN.format("l") + " <> '')"
RULE = "r AS (SELECT doc_id, lang, para_idx, unnest(" + SENTS.format(UNGLUE.format("text")) + ") AS src, generate_subscripts(" + SENTS.format(UNGLUE.format("text")) + ", 1) - 1 AS sent_idx FROM p)"
OFFS = _Sql(
    "list_transform(range(1, len(regexp_extract_all(@0, '@1')) + 1), i -> {'s': list_sum(list_transform(regexp_split_to_array(@0, '@1')[1:i], g -> length(g)))::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(@0, '@1')[1:i-1], g -> length(g))), 0)::BIGINT, "
    "'e': list_sum(list_transform(regexp_split_to_array(@0, '@1')[1:i], g -> length(g)))::BIGINT + list_sum(list_transform(regexp_extract_all(@0, '@1')[1:i], g -> length(g)))::BIGINT})"
)
ARTIFACT = r"(?i)<(bos|eos|pad|unk|s|/s|im_start|im_end)>|<\|[a-z_]+\|>|\x{FFFD}"
NORM = _Sql(r"lower(regexp_replace(@0, '^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$', '', 'g'))")
FOLD = _Sql(r"regexp_replace(lower(@0), '[^\p{L}]', '', 'g')")


@query(f"""WITH {LINES}, {RULE}
SELECT lang, count(*) AS n_sentences, sum(len(regexp_extract_all(src, '{W}')))::BIGINT AS n_words, sum(length(src))::BIGINT AS n_chars, count(DISTINCT doc_id) AS n_docs
FROM r WHERE src <> '' GROUP BY lang""")
def corpus_estimate_by_lang(spark, d):
    """Flagship: sentences, words and characters of the documents by language label."""
    sents = C.sentences_of(C.paragraphs_of(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id"))
    return sents.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(F.size(T.words("src")).cast("long")).alias("n_words"), F.sum(F.length("src").cast("long")).alias("n_chars"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH {LINES}, {RULE} SELECT doc_id, para_idx, sent_idx, src FROM r WHERE src <> ''""")
def sentence_rows(spark, d):
    return C.sentences_of(C.paragraphs_of(table(spark, d, "documents").select("doc_id", "text"), "doc_id")).select("doc_id", "para_idx", "sent_idx", "src")


@query(f"""SELECT para_id, {CLEAN.format('text')} AS cleaned, {UNGLUE.format('text')} AS unglued FROM paragraphs""")
def clean_text(spark, d):
    return table(spark, d, "paragraphs").select("para_id", T.clean("text").alias("cleaned"), T.unglue("text").alias("unglued"))


@query(f"""WITH {S}, o AS (SELECT sentence_id, src, {OFFS.format('src', W)} AS w FROM s WHERE src IS NOT NULL)
SELECT sentence_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, x -> x.s * 31 + x.e)), 0)::BIGINT AS checksum, array_to_string(list_transform(w, x -> substring(src, x.s + 1, x.e - x.s)), '|') AS words FROM o""")
def word_offsets(spark, d):
    s = _s(spark, d).where("src is not null").select("sentence_id", "src", T.offsets("src").alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["s"] * 31 + x["e"])
    return s.select("sentence_id", F.size("w").alias("n_words"), total.alias("checksum"), F.array_join(T.word_strings("src", "w"), "|").alias("words"))


@query(f"""WITH {TR} SELECT translation_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+')) AS n_runs FROM t WHERE text IS NOT NULL""")
def letter_digit_runs(spark, d):
    return _t(spark, d).where("text is not null").select("translation_id", F.size(T.runs("text")).alias("n_runs"))


@query(f"""WITH {S}, w AS (SELECT DISTINCT unnest(regexp_extract_all(src, '{W}')) AS word FROM s), f AS (SELECT word, {FOLD.format('word')} AS folded, {NORM.format('word')} AS normed FROM w)
SELECT word, folded, normed, array_to_string(list_filter([CASE WHEN length(folded) >= 4 AND folded LIKE '%s' THEN left(folded, length(folded) - 1) END, CASE WHEN length(folded) >= 5 AND folded LIKE '%es' THEN left(folded, length(folded) - 2) END], x -> x IS NOT NULL), ',') AS stems FROM f""")
def fold_and_stem(spark, d):
    w = _s(spark, d).select(F.explode(T.words("src")).alias("word")).distinct()
    f = w.select("word", T.fold_letters("word").alias("folded"), T.norm_word("word").alias("normed"))
    return f.select("*", F.array_join(T.stem_variants("folded"), ",").alias("stems"))


@query(f"""WITH {S}, w AS (SELECT list_transform(regexp_extract_all(src, '{W}'), x -> {FOLD.format('x')}) AS w FROM s), u AS (SELECT DISTINCT unnest(list_transform(range(1, len(w)), i -> {{'a': w[i], 'b': w[i + 1]}})) AS x FROM w WHERE len(w) > 1), a AS (SELECT x.a AS a, x.b AS b FROM u),
l AS (SELECT a, b, least(length(a), length(b)) AS m FROM a), k AS (SELECT *, greatest(3, m - CASE WHEN m < 6 THEN m - 3 ELSE 3 END) AS k FROM l)
SELECT a, b, ((a = b AND a <> '') OR (m >= 4 AND left(a, k) = left(b, k))) AS plausible FROM k""")
def prefix_plausible_pairs(spark, d):
    """All pairs of neighbouring words of the sentences."""
    w = _s(spark, d).select(F.transform(T.words("src"), T.fold_letters).alias("w")).where(F.size("w") > 1)
    pairs = F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return w.select(pairs.alias("x")).select("x.a", "x.b").distinct().select("a", "b", T.prefix_plausible("a", "b").alias("plausible"))


@query(f"""WITH {S} SELECT sentence_id, array_to_string(list_transform(regexp_extract_all(src, '{W}'), (w, i) -> (i - 1)::VARCHAR || ':' || w), ' ') AS numbered FROM s WHERE src IS NOT NULL""")
def numbered_words(spark, d):
    return _s(spark, d).where("src is not null").select("sentence_id", T.numbered(T.words("src")).alias("numbered"))


@query(f"""WITH {S}, {TR} SELECT t.translation_id, CASE WHEN regexp_extract(src, '^(\\d{{1,3}}[.)] )', 1) <> '' AND coalesce(text, '') <> '' AND NOT starts_with(text, regexp_extract(src, '^(\\d{{1,3}})[.)] ', 1)) THEN regexp_extract(src, '^(\\d{{1,3}}[.)] )', 1) || text ELSE text END AS text
FROM t JOIN s USING (sentence_id) WHERE regexp_matches(src, '^\\d{{1,3}}[.)] ')""")
def list_mark_restored(spark, d):
    both = _t(spark, d).join(_s(spark, d).where(F.col("src").rlike(r"^\d{1,3}[.)] ")).select("sentence_id", "src"), "sentence_id")
    return both.select("translation_id", T.restore_list_mark("src", "text").alias("text"))


_TAG = """b AS (SELECT book_id, string_split_regex(lower(trim(language)), '[-_]')[1] AS p FROM books),
bk AS (SELECT book_id, CASE WHEN p IN ('eng') THEN 'en' WHEN p IN ('deu', 'ger') THEN 'de' WHEN p IN ('fra', 'fre') THEN 'fr' WHEN p = 'rus' THEN 'ru' WHEN p = 'spa' THEN 'es' WHEN p = 'ita' THEN 'it' WHEN p = 'por' THEN 'pt' WHEN p IN ('nld', 'dut') THEN 'nl'
WHEN p = 'pol' THEN 'pl' WHEN p = 'ukr' THEN 'uk' WHEN p = 'tur' THEN 'tr' WHEN regexp_full_match(p, '[a-z]{2,3}') THEN p ELSE '' END AS tag FROM b)"""


@query(f"""WITH {_TAG} SELECT book_id, tag FROM bk""")
def language_tags(spark, d):
    return table(spark, d, "books").select("book_id", F.coalesce(T.language_tag("language"), F.lit("")).alias("tag"))


@query(f"""WITH {S} SELECT sentence_id FROM s WHERE regexp_matches(src, '{ARTIFACT}')""")
def artifacts(spark, d):
    return _s(spark, d).where(T.is_artifact("src")).select("sentence_id")


@query(f"""WITH {S} SELECT kind, coalesce(regexp_matches(src, '(?i)https?://|www\\.|\\bdoi\\b') OR (length(src) - length(replace(src, ',', '')) >= 3 AND regexp_matches(src, '\\b(1[5-9][0-9]{{2}}|20[0-9]{{2}})\\b')), false) AS citation, count(*) AS n FROM s GROUP BY ALL""")
def citations(spark, d):
    return _s(spark, d).groupBy("kind", T.is_citation("src").alias("citation")).agg(F.count("*").alias("n"))


@query(f"""SELECT book_id, translate(lower(title), '{T.ACCENTED}', '{T.PLAIN}') AS folded FROM books WHERE title IS NOT NULL""")
def folded_titles(spark, d):
    """All titles, in any script."""
    return table(spark, d, "books").where("title is not null").select("book_id", T.fold_latin("title").alias("folded"))


@query("""WITH f AS (SELECT book_id, translate(lower(title), 'áàâäãåéèêëíìîïóòôöõúùûüñçý', 'aaaaaaeeeeiiiiooooouuuuncy') AS f FROM books)
SELECT book_id, coalesce(f <> '' AND (regexp_matches(f, '^\\s*(indice|index|toc|contents?|table of contents|tabla de contenidos?|contenidos?|notas|notes|endnotes|footnotes)\\s*$') OR regexp_matches(f, '\\b(portada|cover|cubierta|sinopsis|synopsis|creditos|copyright|colophon|titlepage|title page|half.?title|ncl.?indice)\\b')), false) AS matter FROM f""")
def matter_titles(spark, d):
    """Whether a title is that of front or back matter."""
    return table(spark, d, "books").select("book_id", T.is_matter("title").alias("matter"))


@query(f"""WITH {S} SELECT sentence_id, sha256(concat_ws('|', 'v8', 'orbit-large', 'en', 'de', src)) AS final_key, sha256(concat_ws('|', 'v5', 'tr', 'orbit-large', 'en', 'de', src)) AS raw_key FROM s WHERE src IS NOT NULL""")
def store_keys(spark, d):
    return _s(spark, d).where("src is not null").select("sentence_id", T.key("v8", "orbit-large", "en", "de", F.col("src")).alias("final_key"), T.key("v5", "tr", "orbit-large", "en", "de", F.col("src")).alias("raw_key"))


def _stores(spark, d):
    """The keyed results of all targets: one text a source and target, the last stored."""
    both = _t(spark, d).where("target is not null").join(_s(spark, d).where("src is not null").select("sentence_id", "src"), "sentence_id")
    return both.groupBy("target", T.key(F.col("src")).alias("hash")).agg(F.max_by("text", F.struct("stored_at", "translation_id")).alias("text")).select("target", "hash", F.concat_ws("|", "target", "hash").alias("key"), "text")


def _wanted(spark, d):
    """Every source in every target that there is; the targets are a handful."""
    w = _s(spark, d).where("src is not null").select(T.key(F.col("src")).alias("hash"), "src").dropDuplicates(["hash"])
    targets = sorted(r.target for r in table(spark, d, "translations").where("target is not null").select("target").distinct().collect())
    return w.select(F.explode(F.array(*map(F.lit, targets)).cast("array<string>")).alias("target"), "hash", "src").select("target", "hash", F.concat_ws("|", "target", "hash").alias("key"), "src")


_STORES = """st AS (SELECT target, key, text FROM (SELECT target, sha256(src) AS key, text, row_number() OVER (PARTITION BY target, sha256(src) ORDER BY stored_at DESC NULLS LAST, translation_id DESC) AS k FROM t JOIN s USING (sentence_id) WHERE target IS NOT NULL AND src IS NOT NULL) WHERE k = 1),
tg AS (SELECT DISTINCT target FROM st), w AS (SELECT DISTINCT target, sha256(src) AS key, src FROM s, tg WHERE src IS NOT NULL)"""


@query(f"""WITH {S}, {TR}, {_STORES}, ok AS (SELECT target, key FROM st WHERE trim(coalesce(text, '')) <> '' AND NOT regexp_matches(text, '{ARTIFACT}')) SELECT w.target, w.key, src FROM w LEFT JOIN ok ON w.target = ok.target AND w.key = ok.key WHERE ok.key IS NULL""")
def pending_work(spark, d):
    """What is wanted and not stored, for every target."""
    stores = _stores(spark, d)
    return C.pending(_wanted(spark, d), stores).select("target", F.col("hash").alias("key"), "src")


@query(f"""WITH {S}, {TR}, {_STORES}, ot AS (SELECT a.target, b.target AS raw_target FROM tg a, tg b WHERE a.target <> b.target),
f AS (SELECT w.target, ot.raw_target, src, CASE WHEN NOT regexp_matches(coalesce(st.text, ''), '{ARTIFACT}') AND trim(st.text) <> '' THEN st.text END AS f, CASE WHEN NOT regexp_matches(coalesce(ra.text, ''), '{ARTIFACT}') AND trim(ra.text) <> '' THEN ra.text END AS r
FROM w JOIN ot ON w.target = ot.target LEFT JOIN st ON st.target = w.target AND st.key = w.key LEFT JOIN st ra ON ra.target = ot.raw_target AND ra.key = w.key)
SELECT target, raw_target, CASE WHEN f IS NOT NULL THEN 'final' WHEN r IS NOT NULL THEN 'raw' ELSE 'none' END AS level, count(*) AS n, sum(length(coalesce(f, CASE WHEN regexp_extract(src, '^(\\d{{1,3}}[.)] )', 1) <> '' AND r IS NOT NULL AND NOT starts_with(r, regexp_extract(src, '^(\\d{{1,3}})[.)] ', 1)) THEN regexp_extract(src, '^(\\d{{1,3}}[.)] )', 1) || r ELSE r END, '')))::BIGINT AS n_chars FROM f GROUP BY ALL""")
def filled_levels(spark, d):
    """Each target as the final text and each other one as the raw text."""
    stores = _stores(spark, d)
    wanted = _wanted(spark, d)
    # one row a source with the texts of all targets, so that the pairs of targets are made inside the row
    by_hash = stores.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("target", "text"))).alias("texts"))
    rows = wanted.groupBy("hash").agg(F.first("src").alias("src"), F.collect_set("target").alias("targets")).join(by_hash, "hash", "left")
    pairs = rows.select("src", "texts", F.explode("targets").alias("target"), "targets").select("src", "texts", "target", F.explode(F.array_except("targets", F.array("target"))).alias("raw_target"))
    out = C.levels(pairs.select("target", "raw_target", "src", F.try_element_at("texts", F.col("target")).alias("_f"), F.try_element_at("texts", F.col("raw_target")).alias("_r")))
    return out.groupBy("target", "raw_target", "level").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("n_chars"))


_AB = f"""WITH {S}, {TR}, m AS (SELECT sentence_id, min(translation_id) AS a, max(translation_id) AS b FROM t GROUP BY 1 HAVING count(*) > 1)"""


def _measured(spark, d):
    words = _s(spark, d).select("sentence_id", "src", "words", "book_id", "ch_idx", "para_idx", "sent_idx")
    return V.measure(_t(spark, d).select("translation_id", "sentence_id", "target", "model", "text", "align", "q").join(words, "sentence_id"))


_M = f"""{S}, {TR}, b AS (SELECT t.translation_id, t.sentence_id, t.target, t.model, coalesce(t.text, '') AS text, coalesce(t.align, []) AS al, coalesce(s.words, []) AS words, {OFFS.format("coalesce(t.text, '')", W)} AS tw FROM t JOIN s USING (sentence_id)),
m AS (SELECT *, len(tw) AS n_tgt, len(list_filter(tw, w -> len(list_filter(al, c -> c.t0 < w.e AND w.s < c.t1 AND len(c.w) > 0)) > 0)) AS n_tgt_covered, len(words) AS n_src, len(list_distinct(list_filter(flatten(list_transform(al, c -> c.w)), i -> i >= 0 AND i < len(words)))) AS n_src_tapped, len(al) AS n_chunks FROM b)"""


@query(f"""WITH {_M} SELECT translation_id, n_tgt, n_tgt_covered, n_src, n_src_tapped, n_chunks FROM m""")
def coverage_overlap(spark, d):
    return _measured(spark, d).select("translation_id", "n_tgt", "n_tgt_covered", "n_src", "n_src_tapped", "n_chunks")


@query(f"""WITH {_M}, c AS (SELECT model, CASE WHEN n_tgt > 0 THEN n_tgt_covered / n_tgt ELSE -1.0 END AS cov, CASE WHEN n_src > 0 THEN n_src_tapped / n_src ELSE -1.0 END AS tap FROM m)
SELECT model, count(*) AS n, round(avg(CASE WHEN cov >= 0 THEN cov END), 6) AS mean_cov, round(list_sort(list(cov) FILTER (WHERE cov >= 0))[(count(*) FILTER (WHERE cov >= 0)) // 2 + 1], 6) AS median_cov, count(*) FILTER (WHERE cov >= 0 AND cov < 0.7) AS n_low_cov, count(*) FILTER (WHERE tap >= 0 AND tap < 0.8) AS n_low_tap FROM c GROUP BY model""")
def coverage_summary(spark, d):
    c = _measured(spark, d).select("model", V.ratio("n_tgt_covered", "n_tgt").alias("cov"), V.ratio("n_src_tapped", "n_src").alias("tap"))
    c = cut(c.groupBy("model", "cov", "tap").agg(F.count("*").alias("k")))  # measured once for both uses below
    some = lambda cond: F.sum(F.when(cond, F.col("k")).otherwise(0))
    ok = F.col("cov") >= 0
    mean = F.sum(F.when(ok, F.col("cov") * F.col("k"))) / F.sum(F.when(ok, F.col("k")))
    flat = c.groupBy("model").agg(F.sum("k").alias("n"), F.round(mean, 6).alias("mean_cov"), some(ok & (F.col("cov") < 0.7)).alias("n_low_cov"), some((F.col("tap") >= 0) & (F.col("tap") < 0.8)).alias("n_low_tap"))
    med = V.ranked_median(c.where("cov >= 0"), ["model"], "cov", "k").select(F.col("model").alias("m2"), F.round("median", 6).alias("median_cov"))
    return flat.join(med, F.col("model").eqNullSafe(F.col("m2")), "left").drop("m2")


@query(f"""WITH {_M}, c AS (SELECT least(greatest(floor((n_tgt_covered / n_tgt) * 10), 0), 9)::INT AS decile, count(*) AS n FROM m WHERE n_tgt > 0 GROUP BY 1)
SELECT i::INT AS decile, coalesce(n, 0)::BIGINT AS n FROM range(10) x(i) LEFT JOIN c ON c.decile = i""")
def coverage_deciles(spark, d):
    c = _measured(spark, d).where("n_tgt > 0").groupBy(V.decile(F.col("n_tgt_covered") / F.col("n_tgt")).alias("decile")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("decile")).join(F.broadcast(c), "decile", "left").fillna(0, ["n"])


_STOPMAP = "map {" + ", ".join(f"'{k}': [" + ", ".join("'" + w.replace("'", "''") + "'" for w in v) + "]" for k, v in V.STOP.items()) + "}"


@query(f"""WITH {_M}, k AS (SELECT *, list_filter(tw, w -> NOT list_contains(coalesce({_STOPMAP}[target], []), lower(substring(text, w.s + 1, w.e - w.s)))) AS cw0 FROM m), c AS (SELECT *, CASE WHEN len(cw0) > 0 THEN cw0 ELSE tw END AS cw FROM k)
SELECT target, sum(len(cw))::BIGINT AS n_content, sum(len(list_filter(cw, w -> len(list_filter(al, c -> c.t0 < w.e AND w.s < c.t1 AND len(c.w) > 0)) > 0)))::BIGINT AS n_content_covered FROM c GROUP BY target""")
def content_coverage(spark, d):
    return _measured(spark, d).groupBy("target").agg(F.sum(F.col("n_content").cast("long")).alias("n_content"), F.sum(F.col("n_content_covered").cast("long")).alias("n_content_covered"))


_DIFF = f"""{_M}, p AS (SELECT sentence_id, min(translation_id) AS a, max(translation_id) AS b FROM t WHERE trim(coalesce(text, '')) <> '' GROUP BY 1 HAVING count(*) > 1),
x AS (SELECT p.sentence_id, ma.text AS ta, mb.text AS tb, CASE WHEN ma.n_tgt > 0 THEN ma.n_tgt_covered / ma.n_tgt ELSE -1.0 END AS ca, CASE WHEN mb.n_tgt > 0 THEN mb.n_tgt_covered / mb.n_tgt ELSE -1.0 END AS cb, ma.n_chunks AS na, mb.n_chunks AS nb FROM p JOIN m ma ON ma.translation_id = p.a JOIN m mb ON mb.translation_id = p.b)"""


def _pairs(spark, d):
    m = _measured(spark, d).select("translation_id", "sentence_id", "text", V.ratio("n_tgt_covered", "n_tgt").alias("c"), "n_chunks")
    both = m.where("trim(coalesce(text, '')) <> ''").groupBy("sentence_id").agg(F.count("*").alias("k"), F.min_by(F.struct("text", "c", "n_chunks"), "translation_id").alias("a"), F.max_by(F.struct("text", "c", "n_chunks"), "translation_id").alias("b"))
    return both.where("k > 1").select("sentence_id", F.col("a.text").alias("ta"), F.col("b.text").alias("tb"), F.col("a.c").alias("ca"), F.col("b.c").alias("cb"), F.col("a.n_chunks").alias("na"), F.col("b.n_chunks").alias("nb"))


@query(f"""WITH {_DIFF} SELECT count(*) AS n_pairs, count(*) FILTER (WHERE ta <> tb) AS n_changed, round(avg(ca), 6) AS mean_a, round(avg(cb), 6) AS mean_b, round(avg(cb - ca), 6) AS mean_delta, round(sum(na) / count(*), 6) AS chunks_a, round(sum(nb) / count(*), 6) AS chunks_b, count(*) FILTER (WHERE cb - ca <= -0.1) AS n_regressed, count(*) FILTER (WHERE cb - ca >= 0.1) AS n_improved FROM x""")
def diff_report(spark, d):
    delta = F.col("cb") - F.col("ca")
    return _pairs(spark, d).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("ta") != F.col("tb")).alias("n_changed"), F.round(F.avg("ca"), 6).alias("mean_a"), F.round(F.avg("cb"), 6).alias("mean_b"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.sum("na") / F.count("*"), 6).alias("chunks_a"), F.round(F.sum("nb") / F.count("*"), 6).alias("chunks_b"), F.count_if(delta <= -0.1).alias("n_regressed"), F.count_if(delta >= 0.1).alias("n_improved"))


@query(f"""WITH {_DIFF} SELECT sentence_id, round(cb - ca, 6) AS delta FROM x WHERE cb < ca ORDER BY cb - ca, sentence_id LIMIT 20""")
def worst_regressions(spark, d):
    return _pairs(spark, d).where("cb < ca").orderBy(F.col("cb") - F.col("ca"), "sentence_id").limit(20).select("sentence_id", F.round(F.col("cb") - F.col("ca"), 6).alias("delta"))


@query(f"""WITH {S}, o AS (SELECT sentence_id, book_id % 2 AS side, src, row_number() OVER (PARTITION BY book_id % 2, src ORDER BY book_id, ch_idx, para_idx, sent_idx, sentence_id) - 1 AS k FROM s WHERE src IS NOT NULL)
SELECT a.sentence_id AS id_a, b.sentence_id AS id_b FROM o a JOIN o b ON a.src = b.src AND a.k = b.k WHERE a.side = 0 AND b.side = 1""")
def occurrence_match(spark, d):
    o = C.occurrences(_s(spark, d).where("src is not null").select("sentence_id", "src", "book_id", "ch_idx", "para_idx", "sent_idx", (F.col("book_id") % 2).alias("side")), "src", ["book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id"], ["side"]).select("side", "src", "occurrence", "sentence_id")
    m = C.matched(o.where("side = 0"), o.where("side = 1"), ["src", "occurrence"])
    return m.select(F.col("sentence_id").alias("id_a"), F.col("sentence_id_b").alias("id_b"))


@query(f"""WITH {S}, e AS (SELECT src FROM s WHERE book_id % 2 = 0 AND src IS NOT NULL), o AS (SELECT src FROM s WHERE book_id % 2 = 1 AND src IS NOT NULL)
SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM o)) AS only_a, (SELECT count(*) FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM e)) AS only_b, (SELECT count(*) FROM (SELECT * FROM e INTERSECT ALL SELECT * FROM o)) AS common""")
def version_sets(spark, d):
    s = _s(spark, d).where("src is not null")
    n = s.groupBy("src").agg(F.count_if(F.col("book_id") % 2 == 0).alias("a"), F.count_if(F.col("book_id") % 2 == 1).alias("b"))
    return n.agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_b"), F.sum(F.least("a", "b")).alias("common"))


@query(f"""WITH {TR}, c AS (SELECT translation_id, unnest(align) AS c FROM t), p AS (SELECT translation_id, c.t0 AS t, unnest(c.w) AS s FROM c)
SELECT translation_id, t, array_to_string(list_sort(list(DISTINCT s)), ',') AS w FROM p WHERE s >= 0 AND t >= 0 GROUP BY 1, 2""")
def chunks_group(spark, d):
    p = _t(spark, d).select("translation_id", F.explode("align").alias("c")).select("translation_id", F.col("c.t0").alias("t"), F.explode("c.w").alias("s"))
    return A.chunks(p, ["translation_id"]).select("translation_id", "t", F.array_join("w", ",").alias("w"))


def _vectors(spark, d):
    """All vectors, as words of made-up sentence pairs: 48 at consecutive places, the even ones the sentence, the odd ones its
    translation. The last pair takes the rest too, so that none is without the other side."""
    v = C.numbered(table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"])
    last = max(v.count() // 48 - 1, 0)
    v = v.withColumn("pair", F.least(F.floor(F.col("pos") / 48), F.lit(last)))
    v = v.select("pair", (F.col("pos") % 2).alias("side"), F.floor((F.col("pos") - F.col("pair") * 48) / 2).cast("int").alias("n"), F.col("embedding").alias("vec"))
    return A.similarities(v.where("side = 0").select("pair", F.col("n").alias("i"), "vec"), v.where("side = 1").select("pair", F.col("n").alias("j"), "vec"), "pair")


_SIM = """v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS total, embedding FROM embeddings), w AS (SELECT least(pos // 48, greatest(total // 48 - 1, 0)) AS pair, pos, embedding FROM v),
x AS (SELECT pair, pos % 2 AS side, ((pos - pair * 48) // 2)::INT AS n, embedding FROM w),
sim AS (SELECT a.pair, a.n AS i, b.n AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM x a JOIN x b ON a.pair = b.pair WHERE a.side = 0 AND b.side = 1),
mb AS (SELECT pair, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY sim DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY sim DESC, i) AS b FROM sim) WHERE a = 1 AND b = 1)"""


@query(f"""WITH {_SIM} SELECT pair, i, j, round(sim, 6) AS sim FROM mb""")
def mutual_argmax(spark, d):
    return A.mutual_best(_vectors(spark, d), "pair").select("pair", "i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_SIM}, fr AS (SELECT * FROM sim WHERE (pair, i) NOT IN (SELECT pair, i FROM mb) AND (pair, j) NOT IN (SELECT pair, j FROM mb) AND sim > 0),
m2 AS (SELECT pair, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY sim DESC, j) AS a, row_number() OVER (PARTITION BY pair, j ORDER BY sim DESC, i) AS b FROM fr) WHERE a = 1 AND b = 1)
SELECT pair, i, j, round(sim, 6) AS sim FROM (SELECT * FROM mb UNION ALL SELECT * FROM m2)""")
def iterated_argmax(spark, d):
    return A.iterated_best(_vectors(spark, d), "pair").select("pair", "i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH {_SIM}, be AS (SELECT pair, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY sim DESC, j) AS a FROM sim WHERE (pair, i) NOT IN (SELECT pair, i FROM mb)) WHERE a = 1 AND sim >= 0.1),
bt AS (SELECT pair, i, j, sim FROM (SELECT *, row_number() OVER (PARTITION BY pair, j ORDER BY sim DESC, i) AS a FROM sim WHERE (pair, j) NOT IN (SELECT pair, j FROM mb)) WHERE a = 1 AND sim >= 0.1)
SELECT DISTINCT 'source' AS side, be.pair, be.i, be.j FROM be JOIN mb ON be.pair = mb.pair AND be.j = mb.j AND abs(be.i - mb.i) BETWEEN 1 AND 3 UNION ALL SELECT DISTINCT 'target', bt.pair, bt.i, bt.j FROM bt JOIN mb ON bt.pair = mb.pair AND bt.i = mb.i AND abs(bt.j - mb.j) BETWEEN 1 AND 3""")
def glued_words(spark, d):
    """Free words of either side glued to the best one of the other that a neighbour has."""
    s = _vectors(spark, d)
    first = A.mutual_best(s, "pair")
    turn = lambda x: x.select("pair", F.col("j").alias("i"), F.col("i").alias("j"), "sim")
    left = A.glue(s, first, "pair", least=0.1).select(F.lit("source").alias("side"), "pair", "i", "j")
    return left.unionByName(A.glue(turn(s), turn(first), "pair", least=0.1).select(F.lit("target").alias("side"), "pair", F.col("j").alias("i"), F.col("i").alias("j")))


_PAIR = ("source_lang", "target")
_EACH = f"""{S}, {TR}, {_TAG}, e AS (SELECT t.translation_id, coalesce(bk.tag, '') AS source_lang, coalesce(t.target, '') AS target, src, text, words, align FROM t JOIN s USING (sentence_id) LEFT JOIN bk ON bk.book_id = s.book_id WHERE src IS NOT NULL AND text IS NOT NULL),
pw AS (SELECT source_lang, target, sw AS s, tw AS t FROM (SELECT source_lang, target, unnest(list_distinct(list_transform(regexp_extract_all(src, '{W}'), x -> {FOLD.format('x')}))) AS sw, list_distinct(list_transform(regexp_extract_all(text, '{W}'), x -> {FOLD.format('x')})) AS tws FROM e), unnest(tws) u(tw)),
lx AS (SELECT source_lang, target, s, t, n, rank FROM (SELECT source_lang, target, s, t, count(*) AS n, row_number() OVER (PARTITION BY source_lang, target, s ORDER BY count(*) DESC, t DESC) AS rank FROM pw GROUP BY source_lang, target, s, t HAVING count(*) >= 3) WHERE rank <= 12)"""
_PREFIX = _Sql("((@0 = @1 AND @1 <> '') OR (least(length(@0), length(@1)) >= 4 AND left(@0, greatest(3, least(length(@0), length(@1)) - CASE WHEN least(length(@0), length(@1)) < 6 THEN least(length(@0), length(@1)) - 3 ELSE 3 END)) = left(@1, greatest(3, least(length(@0), length(@1)) - CASE WHEN least(length(@0), length(@1)) < 6 THEN least(length(@0), length(@1)) - 3 ELSE 3 END))))")
_CHECKED = f"""ch AS (SELECT translation_id, kind, source_lang, target, src, text, words, unnest(align) AS c, generate_subscripts(align, 1) AS chunk FROM al),
cf AS (SELECT *, {FOLD.format('substring(text, c.t0 + 1, c.t1 - c.t0)')} AS t FROM ch WHERE len(c.w) > 0 AND c.t0 >= 0 AND c.t1 <= length(text) AND c.t0 < c.t1),
wq AS (SELECT translation_id, kind, source_lang, target, chunk, src, words, t, unnest(c.w) AS i, true AS own FROM cf WHERE length(t) >= 3 UNION ALL SELECT translation_id, kind, source_lang, target, chunk, src, words, t, unnest([c.w[1] - 1, c.w[len(c.w)] + 1]), false FROM cf WHERE length(t) >= 3),
wr AS (SELECT *, words[i + 1] AS w FROM wq WHERE i >= 0 AND i < len(words)), ws AS (SELECT translation_id, kind, source_lang, target, chunk, t, own, {FOLD.format('substring(src, w.s + 1, w.e - w.s)')} AS s FROM wr WHERE w.s >= 0 AND w.e <= length(src) AND w.s < w.e),
fm AS (SELECT *, unnest(list_filter([s, CASE WHEN length(s) >= 4 AND s LIKE '%s' THEN left(s, length(s) - 1) END, CASE WHEN length(s) >= 5 AND s LIKE '%es' THEN left(s, length(s) - 2) END], x -> x IS NOT NULL)) AS form FROM ws WHERE CASE WHEN own THEN length(s) >= 3 ELSE s <> '' END),
hi AS (SELECT fm.translation_id, kind, fm.source_lang, fm.target, chunk, bool_or(own AND lx.t IS NOT NULL) AS covered, bool_or(own AND coalesce({_PREFIX.format('lx.t', 'fm.t')}, false)) AS supported, bool_or(NOT own AND coalesce({_PREFIX.format('lx.t', 'fm.t')}, false)) AS near
FROM fm LEFT JOIN lx ON lx.source_lang = fm.source_lang AND lx.target = fm.target AND lx.s = fm.form GROUP BY ALL),
su AS (SELECT translation_id, kind, source_lang, target, count(*) FILTER (WHERE covered) AS n_covered, count(*) FILTER (WHERE covered AND supported) AS n_supported, count(*) FILTER (WHERE covered AND NOT supported AND near) AS n_shift_hits FROM hi GROUP BY ALL)"""
_CLEAN = f"{_EACH}, al AS (SELECT translation_id, 'clean' AS kind, source_lang, target, src, text, words, align FROM e), {_CHECKED}"
_REASON = "CASE WHEN n_covered >= 4 AND n_supported <= 0.34::DOUBLE * n_covered THEN 'low-support' WHEN n_shift_hits >= 2 THEN 'shift-pattern' END"


def _all_answers(spark, d):
    """All answers with a text and a source, by the label of the book's language (empty: none) and the target; and their
    distinct folded words."""
    books = table(spark, d, "books").select("book_id", F.coalesce(T.language_tag("language"), F.lit("")).alias("source_lang")).dropDuplicates(["book_id"])
    s = _s(spark, d).where("src is not null").select("sentence_id", "book_id", "src", "words").join(books, "book_id", "left").drop("book_id")
    both = _t(spark, d).where("text is not null").select("translation_id", "sentence_id", F.coalesce("target", F.lit("")).alias("target"), "text", "align").join(s, "sentence_id").fillna("", ["source_lang"])
    fold = lambda c: F.array_distinct(F.transform(T.words(c), T.fold_letters))
    return both, both.select(*_PAIR, fold("src").alias("ss"), fold("text").alias("ts"))


@query(f"""WITH {_EACH} SELECT source_lang, target, s, t, n, rank::INT AS rank FROM lx""")
def lexicon_build(spark, d):
    """A lexicon for each source language and target."""
    return C.lexicon_of(_all_answers(spark, d)[1], by=_PAIR)


def _checked(spark, d):
    both, words = _all_answers(spark, d)
    keys = ["translation_id", *_PAIR]
    return C.checked(C.chunk_words(both, F.col("align"), keys), C.lexicon_of(words, by=_PAIR), keys, _PAIR)


@query(f"""WITH {_CLEAN} SELECT translation_id, source_lang, target, n_covered, n_supported, n_shift_hits, {_REASON} AS reason FROM su""")
def lexicon_checked(spark, d):
    """Support and shift hits by answer and chunk, with the reason of the flag."""
    return _checked(spark, d)


@query(f"""WITH {_CLEAN}, x AS (SELECT source_lang, target, n_covered, n_supported, {_REASON} AS reason FROM su)
SELECT source_lang, target, count(*) AS n_checked, count(*) FILTER (WHERE reason = 'low-support') AS n_low_support, count(*) FILTER (WHERE reason = 'shift-pattern') AS n_shift_pattern, sum(n_covered)::BIGINT AS n_covered, sum(n_supported)::BIGINT AS n_supported FROM x GROUP BY ALL""")
def lexicon_totals(spark, d):
    """How many answers were checked and flagged for each reason, and the dictionary's coverage and support."""
    x = _checked(spark, d)
    flag = lambda r: F.count_if(F.coalesce(F.col("reason") == r, F.lit(False)))
    return x.groupBy(*_PAIR).agg(F.count("*").alias("n_checked"), flag("low-support").alias("n_low_support"), flag("shift-pattern").alias("n_shift_pattern"), F.sum("n_covered").alias("n_covered"), F.sum("n_supported").alias("n_supported"))


_DRIFT = """al AS (SELECT translation_id, kind, source_lang, target, src, text, words, list_transform(align, (c, i) -> CASE WHEN i > f THEN {'t0': c.t0, 't1': c.t1, 'w': list_transform(c.w, x -> ((x + 1) % len(words))::INT)} ELSE c END) AS align
FROM (SELECT *, unnest([{'kind': 'clean', 'f': len(align)}, {'kind': 'full', 'f': 0}, {'kind': 'half', 'f': len(align) - len(align) // 2}], recursive := true) FROM e WHERE len(align) >= 4 AND len(words) >= 5))"""


@query(f"""WITH {_EACH}, {_DRIFT}, {_CHECKED}, g AS (SELECT * FROM su, (SELECT unnest([0.25::DOUBLE, 0.3::DOUBLE, 0.34::DOUBLE, 0.4::DOUBLE, 0.45::DOUBLE]) AS rate_most), (SELECT unnest([2, 3]) AS least_shifts)),
v AS (SELECT *, (n_covered >= 4 AND n_supported <= rate_most * n_covered) OR n_shift_hits >= least_shifts AS flagged FROM g),
n AS (SELECT source_lang, target, count(*) AS n FROM e WHERE len(align) >= 4 AND len(words) >= 5 GROUP BY ALL),
c AS (SELECT source_lang, target, rate_most, least_shifts, count(*) FILTER (WHERE flagged AND kind = 'clean') AS n_false, count(*) FILTER (WHERE flagged AND kind = 'full') AS n_full, count(*) FILTER (WHERE flagged AND kind = 'half') AS n_half FROM v GROUP BY ALL)
SELECT source_lang, target, rate_most, least_shifts, n, n_false, n_full, n_half, round(n_full / n, 6) AS recall_full, round(n_half / n, 6) AS recall_half, round(n_false / n, 6) AS false_rate, round(n_full / greatest(1, n_full + n_false), 6) AS precision FROM c JOIN n USING (source_lang, target)""")
def drift_sweep(spark, d):
    """Of alignments drifted by one word, wholly or in their second half, how many are found, how many sound ones are flagged, and
    the precision, by the rate and the least shift hits."""
    both, words = _all_answers(spark, d)
    both = both.where((F.size("align") >= 4) & (F.size("words") >= 5))
    size = F.size("align")
    drifts = F.array(*[F.struct(F.lit(k).alias("kind"), A.shifted(F.col("align"), F.size("words"), at).alias("align")) for k, at in {"clean": size, "full": F.lit(0), "half": size - F.floor(size / 2).cast("int")}.items()])
    keys = ["translation_id", "kind", *_PAIR]
    copies = both.select("translation_id", *_PAIR, "src", "text", "words", F.explode(drifts).alias("x")).select("translation_id", *_PAIR, "src", "text", "words", "x.kind", F.col("x.align").alias("align"))
    all_ = C.checked(C.chunk_words(copies, F.col("align"), keys), C.lexicon_of(words, by=_PAIR), keys, _PAIR)
    # the grid is laid over counts, not over rows
    few = all_.groupBy(*_PAIR, "kind", "n_covered", "n_supported", "n_shift_hits").agg(F.count("*").alias("k"))
    few = few.withColumn("rate_most", F.explode(F.array(*[F.lit(x) for x in (0.25, 0.3, 0.34, 0.4, 0.45)]))).withColumn("least_shifts", F.explode(F.array(F.lit(2), F.lit(3))))
    flagged = C.low_support(F.col("rate_most")) | (F.col("n_shift_hits") >= F.col("least_shifts"))
    of = lambda kind: F.sum(F.when(flagged & (F.col("kind") == kind), F.col("k")).otherwise(0))
    c = few.groupBy(*_PAIR, "rate_most", "least_shifts").agg(of("clean").alias("n_false"), of("full").alias("n_full"), of("half").alias("n_half"))
    c = c.join(both.groupBy(*_PAIR).agg(F.count("*").alias("n")), [*_PAIR])
    share = lambda x, of: F.round(F.col(x) / of, 6)
    return c.select(*_PAIR, "rate_most", "least_shifts", "n", "n_false", "n_full", "n_half", share("n_full", F.col("n")).alias("recall_full"), share("n_half", F.col("n")).alias("recall_half"), share("n_false", F.col("n")).alias("false_rate"), share("n_full", F.greatest(F.lit(1), F.col("n_full") + F.col("n_false"))).alias("precision"))


@query(f"""WITH {S}, {TR}, x AS (SELECT sentence_id, target, arg_min(text, translation_id) AS tr FROM t WHERE target IS NOT NULL AND text IS NOT NULL GROUP BY ALL), tg AS (SELECT DISTINCT target FROM x),
y AS (SELECT s.sentence_id, book_id, ch_idx, para_idx, sent_idx, coalesce(src, '') AS src, tg.target, coalesce(tr, '') AS tr FROM s CROSS JOIN tg LEFT JOIN x ON x.sentence_id = s.sentence_id AND x.target = tg.target)
SELECT sentence_id, target, len(c) AS n_context, array_to_string(list_transform(c, x -> x.src || '=' || x.tr), '|') AS context FROM (SELECT sentence_id, target, list_filter(list({{'src': src, 'tr': tr}}) OVER (PARTITION BY target, book_id, ch_idx ORDER BY para_idx, sent_idx, sentence_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), x -> x.tr <> '') AS c FROM y) WHERE len(c) > 0""")
def previous_sentences(spark, d):
    """The two sentences before with their translations, for every target."""
    x = _t(spark, d).where("target is not null and text is not null").groupBy("sentence_id", "target").agg(F.min_by("text", "translation_id").alias("tr"))
    x = x.groupBy("sentence_id").agg(F.map_from_entries(F.collect_list(F.struct("target", "tr"))).alias("trs"))  # a sentence stays one row
    y = _s(spark, d).select("sentence_id", "book_id", "ch_idx", "para_idx", "sent_idx", F.coalesce("src", F.lit("")).alias("src")).join(x, "sentence_id", "left")
    before = Window.partitionBy("book_id", "ch_idx").orderBy("para_idx", "sent_idx", "sentence_id").rowsBetween(-2, -1)
    y = y.select("sentence_id", F.filter(F.collect_list(F.struct("src", "trs")).over(before), lambda c: c["trs"].isNotNull()).alias("c"))
    y = y.select("sentence_id", "c", F.explode(F.array_distinct(F.flatten(F.transform("c", lambda c: F.map_keys(c["trs"]))))).alias("target"))
    out = y.select("sentence_id", "target", F.filter("c", lambda c: F.coalesce(F.try_element_at(c["trs"], F.col("target")), F.lit("")) != "").alias("c"))
    return out.where(F.size("c") > 0).select("sentence_id", "target", F.size("c").alias("n_context"), F.array_join(F.transform("c", lambda c: F.concat(c["src"], F.lit("="), F.try_element_at(c["trs"], F.col("target")))), "|").alias("context"))


@query("""SELECT para_id, sum(CASE WHEN role = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, ch_idx ORDER BY para_idx, para_id RANGE UNBOUNDED PRECEDING)::BIGINT AS section FROM paragraphs""")
def sections(spark, d):
    return C.carried(table(spark, d, "paragraphs"), ["book_id", "ch_idx"], ["para_idx", "para_id"], F.col("role") == "heading").select("para_id", "section")


@query("""WITH m AS (SELECT *, role = 'sceneBreak' AS b, max(CASE WHEN role <> 'sceneBreak' THEN 1 END) OVER (PARTITION BY book_id, ch_idx ORDER BY para_idx, para_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, max(CASE WHEN role <> 'sceneBreak' THEN 1 END) OVER (PARTITION BY book_id, ch_idx ORDER BY para_idx, para_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n, lag(role = 'sceneBreak') OVER (PARTITION BY book_id, ch_idx ORDER BY para_idx, para_id) AS l FROM paragraphs)
SELECT para_id FROM m WHERE NOT b OR (p IS NOT NULL AND n IS NOT NULL AND NOT coalesce(l, false))""")
def scene_breaks(spark, d):
    return C.without_loose_breaks(table(spark, d, "paragraphs"), ["book_id", "ch_idx"], ["para_idx", "para_id"], F.col("role") == "sceneBreak").select("para_id")


_RANGES = """pc AS (SELECT para_id, string_split(regexp_replace(text, '([.!?…]["»”’'')\\]]*) (["“«‘'']?\\p{Lu})', '\\1 ' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM paragraphs WHERE length(text) > 0),
se AS (SELECT para_id, (i - 1)::INT AS sent_idx, coalesce(list_sum(list_transform(p[1:i - 1], x -> length(x))), 0)::INT AS b, list_sum(list_transform(p[1:i], x -> length(x)))::INT AS f FROM (SELECT para_id, p, unnest(range(1, len(p) + 1)) AS i FROM pc))"""


def _sentence_ranges(spark, d):
    return C.sentence_ranges(table(spark, d, "paragraphs").where("length(text) > 0").select("para_id", "text"), "para_id")


@query(f"""WITH {_RANGES}, sp AS (SELECT para_id, unnest(spans) AS x FROM paragraphs)
SELECT para_id, sent_idx, greatest(x.s, b) - b AS s, least(x.e, f) - b AS e, x.k AS k FROM sp JOIN se USING (para_id) WHERE x.s < f AND b < x.e""")
def span_clip(spark, d):
    """The paragraphs' spans cut to their sentences."""
    p = table(spark, d, "paragraphs").where("length(text) > 0")
    return C.clipped_spans(p.select("para_id", F.explode("spans").alias("x")).select("para_id", "x.*"), _sentence_ranges(spark, d), "para_id")


@query(f"""WITH {_RANGES}, mk AS (SELECT para_id, m.pos AS pos, m.id AS id FROM (SELECT para_id, unnest(marks) AS m FROM paragraphs)),
r AS (SELECT *, row_number() OVER (PARTITION BY para_id, pos, id ORDER BY CASE WHEN f >= pos THEN 0 ELSE 1 END, CASE WHEN f >= pos THEN f ELSE -f END) AS k FROM mk JOIN se USING (para_id))
SELECT para_id, id, sent_idx, greatest(least(pos, f) - b, 0) AS p FROM r WHERE k = 1""")
def mark_asof(spark, d):
    """Each mark to the first sentence that ends at or behind it."""
    p = table(spark, d, "paragraphs").where("length(text) > 0")
    return C.marks_to_sentences(p.select("para_id", F.explode("marks").alias("x")).select("para_id", "x.pos", "x.id"), _sentence_ranges(spark, d), "para_id")


@query(f"""WITH {S}, o AS (SELECT sentence_id, row_number() OVER (ORDER BY book_id, ch_idx, para_idx, sent_idx, sentence_id) - 1 AS pos, count(*) OVER () AS n FROM s)
SELECT sentence_id FROM o WHERE pos % greatest(1, n // 200) = 0 AND pos < greatest(1, n // 200) * 200""")
def stride_sample(spark, d):
    return C.stride_sample(_s(spark, d).select("book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id"), ["book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id"], 200).select("sentence_id")


@query(f"""WITH {S}, {TR}, u AS (SELECT DISTINCT src FROM t JOIN s USING (sentence_id) WHERE q >= 0.7 AND src IS NOT NULL), n AS (SELECT ceil(count(*) / 20.0)::INT AS n FROM u)
SELECT src FROM (SELECT src, row_number() OVER (ORDER BY sha256(src), src) AS k FROM u) WHERE k <= (SELECT n FROM n)""")
def judge_sample(spark, d):
    u = _t(spark, d).where("q >= 0.7").join(_s(spark, d).where("src is not null").select("sentence_id", "src"), "sentence_id").select("src").distinct()
    return C.clean_sample(u, "src")


_VOTES = """v AS (SELECT sentence_id AS id, sha256('a' || sentence_id::VARCHAR)[1:1] AS a, sha256('b' || sentence_id::VARCHAR)[1:1] AS b FROM (SELECT DISTINCT sentence_id FROM sentences)),
w AS (SELECT id, CASE WHEN a < '6' THEN 'A' WHEN a < 'c' THEN 'B' ELSE 'tie' END AS v1, CASE WHEN b < '6' THEN 'A' WHEN b < 'c' THEN 'B' ELSE 'tie' END AS v2 FROM v)"""


@query(f"""WITH {_VOTES} SELECT count(*) AS n, count(*) FILTER (WHERE v1 = 'tie' OR v2 = 'tie') AS n_ties, count(*) FILTER (WHERE v1 <> 'tie' AND v2 <> 'tie' AND v1 <> v2) AS n_inconsistent, count(*) FILTER (WHERE v1 = v2 AND v1 = 'A') AS wins_a, count(*) FILTER (WHERE v1 = v2 AND v1 = 'B') AS wins_b FROM w""")
def pairwise_outcome(spark, d):
    """Two orders of made-up votes, reconciled."""
    side = lambda p: F.substring(F.sha2(F.concat(F.lit(p), F.col("sentence_id").cast("string")), 256), 1, 1)
    vote = lambda c: F.when(c < "6", "A").when(c < "c", "B").otherwise("tie")
    w = table(spark, d, "sentences").select("sentence_id").distinct().select(vote(side("a")).alias("v1"), vote(side("b")).alias("v2"))
    tie = (F.col("v1") == "tie") | (F.col("v2") == "tie")
    same = (F.col("v1") == F.col("v2")) & ~tie
    return w.agg(F.count("*").alias("n"), F.count_if(tie).alias("n_ties"), F.count_if(~tie & (F.col("v1") != F.col("v2"))).alias("n_inconsistent"), F.count_if(same & (F.col("v1") == "A")).alias("wins_a"), F.count_if(same & (F.col("v1") == "B")).alias("wins_b"))


@query("""SELECT event_id, json_extract_string(regexp_extract('<think>x</think> ok ```json ' || props || ' ``` end', '(?s)(\\{.*\\})', 1), '$.k')::BIGINT AS k FROM events""")
def reply_parse(spark, d):
    reply = F.concat(F.lit("<think>x</think> ok ```json "), F.col("props"), F.lit(" ``` end"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.strip_reply(reply), "$.k").cast("long").alias("k"))


@query(f"""WITH {_M}, r AS (SELECT coalesce(target, '') AS target, trim(text) = '' AS empty, len(list_filter(al, c -> c.t0 < 0 OR c.t0 > c.t1 OR c.t1 > length(text) OR len(list_filter(c.w, i -> i < 0 OR i >= len(words))) > 0)) AS bad, n_tgt, n_tgt_covered, n_src, n_src_tapped, n_chunks FROM m)
SELECT target, count(*) AS n_answers, count(*) FILTER (WHERE empty) AS n_empty, sum(bad)::BIGINT AS n_offset_errors, sum(CASE WHEN n_chunks > 0 THEN n_tgt ELSE 0 END)::BIGINT AS n_tgt_words, sum(CASE WHEN n_chunks > 0 THEN n_tgt_covered ELSE 0 END)::BIGINT AS n_tgt_aligned, sum(CASE WHEN n_chunks > 0 THEN n_src ELSE 0 END)::BIGINT AS n_src_words, sum(CASE WHEN n_chunks > 0 THEN n_src_tapped ELSE 0 END)::BIGINT AS n_src_covered, count(*) FILTER (WHERE n_chunks = 0 AND NOT empty) AS n_unaligned FROM r GROUP BY target""")
def validation_report(spark, d):
    m = _measured(spark, d).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("align", F.coalesce("align", F.array().cast("array<struct<t0:int,t1:int,w:array<int>>>")))
    n = F.size("words")
    bad = F.size(F.filter("align", lambda c: (c["t0"] < 0) | (c["t0"] > c["t1"]) | (c["t1"] > F.length("text")) | F.exists(c["w"], lambda i: (i < 0) | (i >= n))))
    on, empty = F.col("n_chunks") > 0, F.trim("text") == ""
    total = lambda c: F.sum(F.when(on, F.col(c)).otherwise(0).cast("long"))
    return m.groupBy(F.coalesce("target", F.lit("")).alias("target")).agg(F.count("*").alias("n_answers"), F.count_if(empty).alias("n_empty"), F.sum(bad.cast("long")).alias("n_offset_errors"), total("n_tgt").alias("n_tgt_words"), total("n_tgt_covered").alias("n_tgt_aligned"), total("n_src").alias("n_src_words"), total("n_src_tapped").alias("n_src_covered"), F.count_if(~on & ~empty).alias("n_unaligned"))


@query(f"""WITH {S}, {_TAG.replace('b AS (', 'b0 AS (').replace('FROM b)', 'FROM b0)')} SELECT b.book_id, coalesce(nullif(trim(b.title), ''), regexp_replace(b.file_name, '(?i)\\.(fb2\\.zip|fb2|epub)$', '')) AS title, coalesce(nullif(trim(b.author), ''), 'Unknown') AS author, nullif(bk.tag, '') AS detected_language, count(s.sentence_id) FILTER (WHERE kind <> 'note') AS n_sentences, coalesce(sum(len(regexp_extract_all(src, '{W}'))), 0)::BIGINT AS n_words,
coalesce(sum(length(src)), 0)::BIGINT AS n_chars, count(DISTINCT ch_idx) AS n_chapters, count(s.sentence_id) FILTER (WHERE kind = 'note') AS n_note_sentences, coalesce(array_to_string(b.warnings, '|'), '') AS warnings FROM books b LEFT JOIN bk ON bk.book_id = b.book_id LEFT JOIN s ON s.book_id = b.book_id GROUP BY ALL""")
def book_estimates(spark, d):
    """What a book holds, before any pass."""
    s = _s(spark, d).groupBy("book_id").agg(F.count_if(F.col("kind") != "note").alias("n_sentences"), F.sum(F.coalesce(F.size(T.words("src")), F.lit(0)).cast("long")).alias("n_words"), F.sum(F.length("src").cast("long")).alias("n_chars"), F.countDistinct("ch_idx").alias("n_chapters"), F.count_if(F.col("kind") == "note").alias("n_note_sentences"))
    cols = ["n_sentences", "n_words", "n_chars", "n_chapters", "n_note_sentences"]
    b = table(spark, d, "books").select("book_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), T.book_stem("file_name")).alias("title"), F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("Unknown")).alias("author"), F.nullif(T.language_tag("language"), F.lit("")).alias("detected_language"), F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"))
    return b.join(s, "book_id", "left").fillna(0, cols)


@query("""SELECT nullif(trim(model), '') AS model, nullif(trim(phase), '') AS phase, count(*) AS n, count(*) FILTER (WHERE status = 200) AS n_ok, coalesce(sum(prompt_tokens), 0)::BIGINT AS n_prompt, coalesce(sum(completion_tokens), 0)::BIGINT AS n_completion, max(attempt) AS most_attempts
FROM (SELECT DISTINCT req_id, ts, model, phase, attempt, latency_ms, status, prompt_tokens, completion_tokens FROM request_stats) GROUP BY 1, 2""")
def request_totals(spark, d):
    r = table(spark, d, "request_stats").select("req_id", "ts", "model", "phase", "attempt", "latency_ms", "status", "prompt_tokens", "completion_tokens").distinct()
    blank = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    return r.groupBy(blank("model"), blank("phase")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("n_ok"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("n_prompt"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("n_completion"), F.max("attempt").alias("most_attempts"))


@query("""SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def throughput_windows(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "total")


@query()
def throttled_progress(spark, d):
    from tessella.streaming.progress import throttle

    e = table(spark, d, "events").select(F.col("event_type").alias("phase"), F.col("user_id").cast("string").alias("target"), "ts", F.floor("value").cast("long").alias("done"), F.lit(100).cast("long").alias("total"), F.lit(False).alias("final"))
    return throttle(e)


@query("""WITH p AS (SELECT book_id, ch_idx, para_idx, para_id, role, """ + CLEAN.format("coalesce(text, '')") + """ AS text FROM paragraphs), k AS (SELECT * FROM p WHERE text <> '' OR role = 'sceneBreak')
SELECT book_id, ch_idx, (row_number() OVER (PARTITION BY book_id, ch_idx ORDER BY para_idx, para_id) - 1)::INT AS idx, CASE role WHEN 'heading' THEN 'heading' WHEN 'subtitle' THEN 'subtitle' WHEN 'sceneBreak' THEN 'sceneBreak' ELSE 'body' END AS role, CASE WHEN role = 'sceneBreak' THEN '' ELSE text END AS text FROM k""")
def html_blocks(spark, d):
    """Whole chapters as made-up pages, with boilerplate, notes and scripts between, parsed again."""
    from tessella.sources.html import close_raw_elements, page_blocks

    p = table(spark, d, "paragraphs").withColumn("text", F.coalesce("text", F.lit("")))
    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tagged = F.when(F.col("role") == "heading", F.concat(F.lit("<h2>"), esc, F.lit("</h2><script>x</script>"))).when(F.col("role") == "subtitle", F.concat(F.lit('<p class="subtitle">'), esc, F.lit("</p>"))).when(F.col("role") == "sceneBreak", "<hr/>").otherwise(F.concat(F.lit("<p>"), esc, F.lit('<p class="footnote">no</p>')))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_idx", "para_id", tagged.alias("t")))), lambda x: x["t"]), "\n")
    pages = p.groupBy("book_id", "ch_idx").agg(body.alias("b"))  # a chapter is one page
    html = F.concat(F.lit("<html><head><title/></head><body><nav>skip</nav><div class='pg-boilerplate'><p>skip</p></div><div>"), F.col("b"), F.lit("</div></body></html>"))
    rows = page_blocks(pages.select(F.concat_ws("/", "book_id", "ch_idx").alias("page"), close_raw_elements(html).alias("html")), "page")
    at = lambda i: F.element_at(F.split("page", "/"), i)
    return rows.select(at(1).cast("bigint").alias("book_id"), at(2).cast("int").alias("ch_idx"), "idx", "role", "text")


@query(f"""WITH {S} SELECT count(*) AS n_stored, count(*) FILTER (WHERE text = '[xx] ' || src) AS n_tagged FROM (SELECT DISTINCT src, '[xx] ' || src AS text FROM s WHERE trim(src) <> '' AND NOT regexp_matches(src, '{ARTIFACT}'))""")
def retry_rounds(spark, d):
    """All distinct sources through a stand-in provider, from an empty store."""
    from tessella.operators.passes import run_rounds, tagging_provider

    wanted = _s(spark, d).where((F.trim("src") != "") & ~T.is_artifact("src")).select(T.key(F.col("src")).alias("key"), "src").dropDuplicates(["key"])
    store = run_rounds(wanted, spark.createDataFrame([], "key string, text string"), tagging_provider("xx"))
    return store.join(wanted, "key").agg(F.count("*").alias("n_stored"), F.count_if(F.col("text") == F.concat(F.lit("[xx] "), F.col("src"))).alias("n_tagged"))


@query(f"""WITH {S}, pr AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '{W}')[1:3], ' ') AS expr FROM paragraphs WHERE role IN ('heading', 'subtitle') AND len(regexp_extract_all(lower(text), '{W}')) >= 3),
w AS (SELECT sentence_id, regexp_extract_all(lower(src), '{W}') AS w FROM s), g AS (SELECT DISTINCT sentence_id, unnest(list_transform(range(1, len(w) - 1), i -> w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS expr FROM w WHERE len(w) >= 3)
SELECT expr, count(sentence_id) AS n_found, CASE WHEN count(sentence_id) = 0 THEN 'src-not-found' ELSE 'matched' END AS verdict FROM pr LEFT JOIN g USING (expr) GROUP BY expr""")
def probe_verdicts(spark, d):
    """The first three words of every heading looked for in all sentences, as a sequence of words: an equi-join of word triples,
    counted before they travel."""
    three = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    low = T.words(F.lower("text"))
    p = table(spark, d, "paragraphs").where(F.col("role").isin("heading", "subtitle")).select(low.alias("w")).where(F.size("w") >= 3).select(F.array_join(F.slice("w", 1, 3), " ").alias("expr")).distinct()
    s = _s(spark, d).select(T.words(F.lower("src")).alias("w")).where(F.size("w") >= 3).select(F.explode(F.array_distinct(three(F.col("w")))).alias("expr"))
    hit = s.groupBy("expr").agg(F.count("*").alias("n_found"))
    return p.join(hit, "expr", "left").fillna(0, ["n_found"]).select("expr", "n_found", F.when(F.col("n_found") == 0, "src-not-found").otherwise("matched").alias("verdict"))


@query(f"""WITH {S} SELECT sentence_id, ((row_number() OVER (PARTITION BY book_id ORDER BY ch_idx, para_idx, sent_idx, sentence_id) - 1) // 16)::BIGINT AS batch FROM s""")
def batch_ids(spark, d):
    """Consecutive batches of 16 within a book; a large book's places come from ranges, not from one task."""
    return C.batches(_s(spark, d).select("sentence_id", "book_id", "ch_idx", "para_idx", "sent_idx"), ["book_id"], ["ch_idx", "para_idx", "sent_idx", "sentence_id"], 16).select("sentence_id", "batch")


@query("""SELECT book_id, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM translations WHERE target IS NOT NULL GROUP BY 1""")
def targets_union(spark, d):
    return table(spark, d, "translations").where("target is not null").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


@query(f"""WITH {S} SELECT src, arg_min(sentence_id, struct_pack(a := book_id, b := ch_idx, c := para_idx, d := sent_idx, e := sentence_id)) AS first_id, arg_max(sentence_id, struct_pack(a := book_id, b := ch_idx, c := para_idx, d := sent_idx, e := sentence_id)) AS last_id, count(*) AS n FROM s WHERE src IS NOT NULL GROUP BY src HAVING count(*) > 1""")
def first_and_last(spark, d):
    """The first and the last occurrence of texts that recur."""
    order = F.struct("book_id", "ch_idx", "para_idx", "sent_idx", "sentence_id")
    g = _s(spark, d).where("src is not null").groupBy("src").agg(F.min_by("sentence_id", order).alias("first_id"), F.max_by("sentence_id", order).alias("last_id"), F.count("*").alias("n"))
    return g.where("n > 1")


@query("""SELECT coalesce(nullif(left(trim(err), 60), ''), 'unspecified') AS reason, count(*) AS n FROM request_stats WHERE status <> 200 GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""")
def failure_reasons(spark, d):
    """The ten most frequent reasons of failed requests."""
    reason = F.coalesce(F.nullif(F.substring(F.trim("err"), 1, 60), F.lit("")), F.lit("unspecified"))
    return table(spark, d, "request_stats").where("status <> 200").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(f"""WITH {_M}, k AS (SELECT coalesce(s.kind, '') AS kind, m.* FROM m JOIN s ON m.sentence_id = s.sentence_id)
SELECT coalesce(kind, 'all') AS kind, count(*) AS n, count(*) FILTER (WHERE n_src > 0 AND n_src_tapped = n_src) AS n_full, count(*) FILTER (WHERE n_src_tapped > 0 AND n_src_tapped < n_src) AS n_partial, count(*) FILTER (WHERE n_src_tapped = 0) AS n_none FROM k GROUP BY ROLLUP (kind)""")
def coverage_by_kind(spark, d):
    """Fully, partly and not covered answers by kind of sentence, and over all."""
    m = _measured(spark, d).join(_s(spark, d).select("sentence_id", F.coalesce("kind", F.lit("")).alias("kind")), "sentence_id")
    t, n = F.col("n_src_tapped"), F.col("n_src")
    out = m.rollup("kind").agg(F.count("*").alias("n"), F.count_if((n > 0) & (t == n)).alias("n_full"), F.count_if((t > 0) & (t < n)).alias("n_partial"), F.count_if(t == 0).alias("n_none"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("all")))


@query("""WITH h AS (SELECT book_id, ch_idx, min(para_idx) AS p0 FROM paragraphs GROUP BY 1, 2), x AS (SELECT h.book_id, h.ch_idx, b.title, p.text FROM h JOIN books b USING (book_id) LEFT JOIN paragraphs p ON p.book_id = h.book_id AND p.ch_idx = h.ch_idx AND p.para_idx = h.p0 AND p.role = 'heading')
SELECT book_id, ch_idx, count(*) FILTER (WHERE trim(coalesce(title, '')) <> '' AND lower(coalesce(text, '')) <> lower(title)) > 0 AS inserted FROM x GROUP BY 1, 2""")
def title_headings(spark, d):
    """Chapters before which the title is put as a heading: it is not blank and does not lead already."""
    p = table(spark, d, "paragraphs")
    lead = p.groupBy("book_id", "ch_idx").agg(F.min("para_idx").alias("p0"))
    heads = p.where("role = 'heading'").select("book_id", "ch_idx", F.col("para_idx").alias("p0"), "text")
    x = lead.join(table(spark, d, "books").select("book_id", "title"), "book_id").join(heads, ["book_id", "ch_idx", "p0"], "left")
    new = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.lower(F.coalesce("text", F.lit(""))) != F.lower("title"))
    return x.groupBy("book_id", "ch_idx").agg(F.max(F.coalesce(new, F.lit(False))).alias("inserted"))


@query(f"""WITH {TR}, w AS (SELECT target, lower(unnest(regexp_extract_all(text, '{W}'))) AS w FROM t) SELECT target, count(*) AS n_words, count(*) FILTER (WHERE list_contains(coalesce({_STOPMAP}[target], []), w)) AS n_stop FROM w GROUP BY target""")
def stop_words(spark, d):
    """Words and closed-class words of the answers by their own language."""
    lists = F.create_map(*[x for k, v in V.STOP.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    w = _t(spark, d).select("target", F.explode(T.words("text")).alias("w")).groupBy("target", F.lower("w").alias("w")).agg(F.count("*").alias("n"))
    known = F.array_contains(F.coalesce(F.try_element_at(lists, F.col("target")), F.array().cast("array<string>")), F.col("w"))
    return w.groupBy("target").agg(F.sum("n").alias("n_words"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n_stop"))

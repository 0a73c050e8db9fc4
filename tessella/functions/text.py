"""Text scalars as native column expressions: cleaning, words with offsets, folds, stems, tags, classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters and marks, joined by apostrophes or hyphens; digits are none.
WORD = r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"
#: The other tokenizer: runs of letters and digits.
RUN = r"[\p{L}\p{Nd}]+"
GLUE = r"([.!?…]{1,3}[\"»”’')\]]?)(\p{Lu})"
SPLIT = r"([.!?…][\"»”’')\]]*) ([\"“«‘']?\p{Lu})"
SEP = "\u0001"
ARTIFACT = r"(?i)<(bos|eos|pad|unk|s|/s|im_start|im_end)>|<\|[a-z_]+\|>|\x{FFFD}"
# --- fixed values: accented letters and what they fold to; three-letter language codes
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñý", "aaaaaaeeeeiiiiooooouuuucny"
ISO3 = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "rus": "ru", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "ukr": "uk", "tur": "tr"}
# --- fixed values: names of languages in prompts
LANG_NAMES = {
    "ru": "Russian", "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "pt": "Portuguese", "uk": "Ukrainian", "pl": "Polish", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "tr": "Turkish", "nl": "Dutch", "ar": "Arabic",
}
# --- fixed values: titles of front and back matter, folded, whole or with one of the words
MATTER_EXACT = r"^\s*(indice|index|toc|contents?|table of contents|tabla de contenidos?|contenidos?|notas|notes|endnotes|footnotes)\s*$"
MATTER_LOOSE = r"\b(portada|cover|cubierta|sinopsis|synopsis|creditos|copyright|colophon|titlepage|title page|half.?title|ncl.?indice)\b"
# --- fixed values: marks trimmed before a note; statuses that are final; wordings of an exhausted quota
LEADING = r"^[.,:;)\]* ]+"
PERMANENT = (400, 401, 402, 403, 404)
EXHAUSTED = r"(?i)(usage limit|session limit|hit your .{0,20}limit|limit reached)"
# --- fixed values: what makes a note a citation
URL, YEAR = r"(?i)https?://|www\.|(?<![0-9A-Za-z_])doi(?![0-9A-Za-z_])", r"(?<![0-9A-Za-z_])(1[5-9][0-9]{2}|20[0-9]{2})(?![0-9A-Za-z_])"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Every Unicode white-space run to one blank, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def unglue(c) -> Column:
    """A blank between a sentence mark and the capital glued to it; cleaned."""
    return clean(F.regexp_replace(_c(c), GLUE, "$1 $2"))


def words(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(f"({WORD})"), F.lit(1))


def plain_words(text: str) -> list[str]:
    """As words, for one text outside a plan."""
    import regex

    return regex.findall(WORD, text)


def runs(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(f"({RUN})"), F.lit(1))


def rule_sentences(c) -> Column:
    """Sentences by the mark-blank-capital rule."""
    return F.split(F.regexp_replace(unglue(c), SPLIT, f"$1{SEP}$2"), SEP)


# --- fixed values: abbreviations that end no sentence, by language; other languages go by the English ones
ABBREVIATIONS = {
    "en": "Mr Mrs Ms Dr Prof St Mt Rev Hon Capt Col Gen Lt Sgt Jr Sr vs cf No Vol Fig Ch pp e.g i.e viz approx",
    "ru": "т.е т.к т.н г гг ул им стр рис см гл пр пер проф др акад",
    "lt": "pvz t.y vnt psl pav žr plg prof dr",
    "he": "ד״ר פרופ עמ מס",
}


def ruled_sentences(c, lang) -> Column:
    """Sentences by the rules of a language: behind a mark and a blank before a capital or a caseless letter, but not behind an
    abbreviation, an initial or a list number; in Chinese and Japanese behind the mark alone. Nothing is lost: the pieces make up the
    cleaned text. Null stays null."""
    c = unglue(c)
    primary = F.coalesce(language_tag(lang), F.lit("en"))

    def cut(short: str) -> Column:
        words = "|".join(w.replace(".", r"\.") for w in short.split())
        guard = rf"(?<!(?:^|[\s(«“„])(?:{words})\.)(?<!(?:^|[\s.])\p{{Lu}}\.)(?<!^[(\[]?\d{{1,3}}[.)])"
        return F.regexp_replace(c, rf"([.!?…][\"»”’')\]]*){guard} (?=[\"“«‘'(]?[\p{{Lu}}\p{{Lo}}\d])", f"$1{SEP}")

    bare = F.regexp_replace(c, r"([。！？!?…]+[」』”’）)]*)(?=[^\s。！？!?…」』”’）)])", f"$1{SEP}")
    out = F.when(primary.isin("ja", "zh"), bare)
    for code, short in ABBREVIATIONS.items():
        if code != "en":
            out = out.when(primary == code, cut(short))
    return F.transform(F.split(out.otherwise(cut(ABBREVIATIONS["en"])), SEP), lambda x: F.trim(x))


def offsets(c, pattern: str = WORD) -> Column:
    """array<struct<s,e>> of the pattern's matches: prefix sums over the gaps between them and their lengths."""
    c = _c(c)
    gaps = F.split(c, pattern, -1)
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    step = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, w: F.struct(F.length(g).alias("g"), F.length(w).alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    fold = F.aggregate(step, start, lambda a, x: F.struct((a["at"] + x["g"] + x["w"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["w"]).alias("e")))).alias("out")))
    return F.coalesce(fold["out"], F.array().cast("array<struct<s:int,e:int>>"))


def word_strings(src, spans) -> Column:
    """The substrings of spans; an invalid span gives an empty string."""
    src = _c(src)
    ok = lambda w: (w["s"] >= 0) & (w["s"] < w["e"]) & (w["e"] <= F.length(src))
    return F.transform(_c(spans), lambda w: F.when(ok(w), F.substring(src, w["s"] + 1, w["e"] - w["s"])).otherwise(F.lit("")))


def numbered(ws) -> Column:
    """Words with their numbers: '0:The 1:cat'."""
    return F.array_join(F.transform(_c(ws), lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " ")


def norm_word(c) -> Column:
    return F.lower(F.regexp_replace(_c(c), r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$", ""))


def fold_letters(c) -> Column:
    """Small letters only."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}]", "")


def stem_variants(c) -> Column:
    """Without a final s (four letters or more) and es (five or more)."""
    c, n = _c(c), F.length(_c(c))
    return F.filter(F.array(F.when((n >= 4) & c.endswith("s"), F.substring(c, F.lit(1), n - 1)), F.when((n >= 5) & c.endswith("es"), F.substring(c, F.lit(1), n - 2))), lambda x: x.isNotNull())


def prefix_plausible(a, b) -> Column:
    """Equal, or both of four letters or more with a long enough common beginning (slack 3, less for short words)."""
    a, b = _c(a), _c(b)
    low = F.least(F.length(a), F.length(b))
    k = F.greatest(F.lit(3), low - F.when(low < 6, low - 3).otherwise(F.lit(3)))
    return ((a == b) & (a != "")) | ((low >= 4) & (F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))


def restore_list_mark(src, tr) -> Column:
    """Puts a source's list number before a translation that lost it; an empty text stays."""
    mark = F.regexp_extract(_c(src), r"^(\d{1,3}[.)] )", 1)
    digits = F.regexp_extract(_c(src), r"^(\d{1,3})[.)] ", 1)
    return F.when((mark != "") & (F.coalesce(_c(tr), F.lit("")) != "") & ~F.startswith(_c(tr), digits), F.concat(mark, _c(tr))).otherwise(_c(tr))


def fold_latin(c) -> Column:
    return F.translate(F.lower(_c(c)), ACCENTED, PLAIN)


def language_tag(c) -> Column:
    """Primary subtag in small letters, three letters to two where known; empty where it is no tag of two or three letters. Null
    stays null."""
    p = F.element_at(F.split(F.lower(F.trim(_c(c))), "[-_]"), 1)
    three = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    return F.when(p.rlike("^[a-z]{2,3}$"), F.coalesce(F.try_element_at(three, p), p)).when(p.isNotNull(), F.lit(""))


def language_name(c) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANG_NAMES.items() for x in kv]), _c(c)), _c(c))


def is_artifact(c) -> Column:
    """Leaked special tokens or replacement characters."""
    return F.coalesce(_c(c).rlike(ARTIFACT), F.lit(False))


def is_citation(c) -> Column:
    """An address or DOI, or three commas and a year from 1500 to 2099."""
    c = _c(c)
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    return F.coalesce(c.rlike(URL) | ((commas >= 3) & c.rlike(YEAR)), F.lit(False))


def is_matter(title) -> Column:
    """Front and back matter by its title or, underscores and hyphens as blanks, its file name."""
    folded = fold_latin(title)
    return F.coalesce((folded != "") & (folded.rlike(MATTER_EXACT) | folded.rlike(MATTER_LOOSE)), F.lit(False))


def strip_reply(c) -> Column:
    """A model's reply without thinking and fences; the outermost object in it, else empty. Unended thinking gives empty."""
    c = F.regexp_replace(_c(c), r"(?s)^\s*<think>.*?</think>", "")
    c = F.when(c.rlike(r"(?s)^\s*<think>"), F.lit("")).otherwise(c)
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def clean_place(raw, at: Column) -> Column:
    """The place in clean(raw) of the raw offset ``at``."""
    head = F.regexp_replace(F.regexp_replace(F.substring(_c(raw), F.lit(1), at), r"(?U)^\s+", ""), r"(?U)\s+", " ")
    return F.least(F.length(head), F.length(clean(raw)))


def leading_marks(c) -> Column:
    """How many characters of punctuation and blanks a text begins with; spans move left by as many."""
    return F.length(F.regexp_extract(_c(c), LEADING, 0))


def without_leading_marks(c) -> Column:
    return F.regexp_replace(_c(c), LEADING, "")


def book_stem(c) -> Column:
    """A file name without the extension of a book."""
    return F.regexp_replace(_c(c), r"(?i)\.(fb2\.zip|fb2|epub)$", "")


def listed(c) -> Column:
    """A comma list as an array: trimmed, blanks dropped, each once in the order they come."""
    return F.array_distinct(F.filter(F.transform(F.split(_c(c), ","), lambda x: F.trim(x)), lambda x: x != ""))


def sources_listed(c) -> Column:
    """A list of sources: a JSON array of strings, else one a line; blank ones go."""
    lines = F.filter(F.transform(F.split(_c(c), "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.ltrim(_c(c)).startswith("["), F.filter(F.from_json(_c(c), "array<string>"), lambda x: F.trim(x) != "")), lines)


def is_permanent(status) -> Column:
    """Statuses that no retry mends."""
    return _c(status).isin(*PERMANENT)


def is_exhausted(err) -> Column:
    """Wordings of an exhausted quota."""
    return F.coalesce(_c(err).rlike(EXHAUSTED), F.lit(False))


def reset_at(err) -> Column:
    """The second at which an exhausted quota begins anew, where the message tells it."""
    return F.nullif(F.regexp_extract(_c(err), r"\|([0-9]{10})(?![0-9A-Za-z_])", 1), F.lit("")).cast("bigint")


def found_at(hay, needle) -> Column:
    """Where a text stands in another, capitals aside; -1 where it does not."""
    return F.call_function("instr", F.lower(_c(hay)), F.lower(_c(needle))) - 1


def percent(a, n) -> Column:
    return 100 * _c(a) / F.greatest(_c(n), F.lit(1))


def key(*parts) -> Column:
    """Content key: SHA-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)

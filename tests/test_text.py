from pyspark.sql import functions as F

from tessella.functions import text as T


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first()["x"]


def test_clean_and_unglue(spark):
    assert one(spark, T.clean("a"), a=" x 　y\t\nz ") == "x y z"
    assert one(spark, T.unglue("a"), a="He left.She stayed!”Then") == "He left. She stayed!” Then"


def test_words_with_offsets(spark):
    text = "It’s 3 well-known cafés 🙂 да"
    got = one(spark, T.offsets("a"), a=text)
    assert [text[r["s"]:r["e"]] for r in got] == ["It’s", "well-known", "cafés", "да"]
    assert one(spark, T.offsets("a"), a="") == []
    assert one(spark, F.size(T.runs("a")), a="a1 b-2") == 3


def test_word_strings_invalid_span_is_empty(spark):
    df = spark.createDataFrame([("abc", [(0, 2), (2, 9), (1, 1)])], "t string, w array<struct<s:int,e:int>>")
    assert df.select(T.word_strings("t", "w").alias("x")).first().x == ["ab", "", ""]


def test_stems_and_prefix(spark):
    assert one(spark, T.stem_variants("a"), a="boxes") == ["boxe", "box"]
    assert one(spark, T.stem_variants("a"), a="bus") == []
    assert one(spark, T.prefix_plausible("a", "b"), a="houses", b="house")
    assert not one(spark, T.prefix_plausible("a", "b"), a="cat", b="cats")
    assert not one(spark, T.prefix_plausible("a", "b"), a="", b="")


def test_list_mark(spark):
    assert one(spark, T.restore_list_mark("a", "b"), a="3. Go", b="Geh") == "3. Geh"
    assert one(spark, T.restore_list_mark("a", "b"), a="3. Go", b="3) Geh") == "3) Geh"
    assert one(spark, T.restore_list_mark("a", "b"), a="3. Go", b="") == ""


def test_tags_artifacts_citations(spark):
    assert one(spark, T.language_tag("a"), a="pt_BR") == "pt"
    assert one(spark, T.language_tag("a"), a="deu") == "de"
    assert one(spark, T.language_tag("a"), a="English") == ""
    assert [one(spark, T.language_tag("a"), a=x) for x in ("nld", "dut", "pol", "tur", "en-US", "x", "abcd", "e1", " FR ")] == ["nl", "nl", "pl", "tr", "en", "", "", "", "fr"]
    assert one(spark, T.language_name("a"), a="ko") == "Korean" and one(spark, T.language_name("a"), a="xx") == "xx"
    assert all(one(spark, T.is_matter("a"), a=x) for x in ("Índice", " TOC ", "Contents", "Half-Title", "The Cover", "Sinopsis", "notes")) and not any(one(spark, T.is_matter("a"), a=x) for x in ("", "Notes of a traveller", "Covered", "Chapter 1", "Discontents"))
    assert one(spark, T.is_citation("a"), a="See doi 10.1") and one(spark, T.is_citation("a"), a="(DOI)") and not one(spark, T.is_citation("a"), a="doing so")
    assert one(spark, T.is_artifact("a"), a="x <|im_end|>")
    assert one(spark, T.is_citation("a"), a="Vell, J., Oake, R., Salt, 1874, p. 3")
    assert not one(spark, T.is_citation("a"), a="In 1874, he left.")


def test_reply(spark):
    assert one(spark, T.strip_reply("a"), a='<think>no</think> ```json {"1": "x"} ```') == '{"1": "x"}'
    assert one(spark, T.strip_reply("a"), a="<think>never ends {}") == ""


def test_places_lists_and_errors(spark):
    raw = "\u00a0 a  b\tc "
    got = [one(spark, T.clean_place("a", F.lit(i)), a=raw) for i in range(len(raw) + 1)]
    from tessella.sources.html import squeeze

    assert one(spark, T.clean("a"), a=raw) == squeeze(raw)[0] and got == squeeze(raw)[1]
    assert one(spark, T.without_leading_marks("a"), a="): The* end") == "The* end" and one(spark, T.leading_marks("a"), a="): The end") == 3 and one(spark, T.leading_marks("a"), a="The") == 0
    assert [one(spark, T.book_stem("a"), a=x) for x in ("a.FB2.zip", "b.fb2", "c.epub", "d.txt", "e.zip")] == ["a", "b", "c", "d.txt", "e.zip"]
    assert one(spark, T.listed("a"), a=" de, ,ru,de ") == ["de", "ru"]
    assert one(spark, T.sources_listed("a"), a='["x", " ", "y,z"]') == ["x", "y,z"] and one(spark, T.sources_listed("a"), a="x\r\n\ny ") == ["x", "y"]
    assert one(spark, T.is_exhausted("a"), a="You hit your weekly limit|1700000000") and one(spark, T.reset_at("a"), a="limit reached|1700000000") == 1700000000 and one(spark, T.reset_at("a"), a="|17000000001") is None
    assert one(spark, T.is_permanent("a"), a=404) and not one(spark, T.is_permanent("a"), a=429)
    assert one(spark, T.found_at("a", "b"), a="The LAMP", b="lamp") == 4 and one(spark, T.found_at("a", "b"), a="x", b="lamp") == -1
    assert T.plain_words("It’s a 3-day café") == ["It’s", "a", "day", "café"]


def test_sentences_by_language(spark):
    cut = lambda t, lang: one(spark, T.ruled_sentences("a", F.lit(lang)), a=t)
    assert cut("Dr. Vell left. J. R. Oake ran!  “Who?” Then 3.5 kg.", "en") == ["Dr. Vell left.", "J. R. Oake ran!", "“Who?”", "Then 3.5 kg."]
    assert cut("3. The end came. (It did.) Yes", "xx") == ["3. The end came.", "(It did.)", "Yes"]
    assert cut("Он ушёл, т.е. Иван. См. рис. Это всё.", "ru") == ["Он ушёл, т.е. Иван.", "См. рис. Это всё."]
    assert cut("谁点亮了灯？画家说：“走！”他走了。", "zh") == ["谁点亮了灯？", "画家说：“走！”", "他走了。"]
    assert cut("הוא הלך. היא רצה.", "he") == ["הוא הלך.", "היא רצה."] and cut("", "en") == [""]

import pytest
from pyspark.sql import functions as F
from test_sources import epub

from tessella.operators import passes as P
from tessella.plans import convert as V
from tessella.sources import books as B
from tessella.sources import files as S


@pytest.fixture(scope="module")
def sentences(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "x.epub").write_bytes(epub({"a": "<h1>A</h1><p>The red dog ran. It sat down!</p><p>3. The end came.</p>", "b": "<p>The red dog ran.</p><table><tr><td>one</td><td>two</td></tr></table>"}, ["a", "b"]))
    return V.sentences_of_books(B.read_epub(spark, str(d / "*.epub"))).cache()


def test_sentences_and_estimate(sentences):
    got = [(r.ch_idx, r.role, r.src) for r in sentences.orderBy("ch_idx", "para_idx", "sent_idx").collect()]
    assert got == [(0, "body", "The red dog ran."), (0, "body", "It sat down!"), (0, "body", "3. The end came."), (1, "body", "The red dog ran."), (1, "cell", "one"), (1, "cell", "two")]
    r = V.estimate(sentences).first()
    assert (r.n_chapters, r.n_sentences, r.n_words) == (2, 6, 16)


def test_a_book_is_converted_and_goes_on(spark, sentences, tmp_path):
    calls = []
    failed = []

    def translate(items):
        if not failed:
            failed.append(1)
            raise RuntimeError("first call fails")
        return {x["id"]: f"[de] {x['src']}" for x in items}

    o = V.Options("en", "de", str(tmp_path / "store"), P.tagging_provider("de"), align=P.echoing_aligner(), judge=P.length_judge(), terms=P.long_words_glossary("de"))
    out = V.run(spark, sentences, o)
    filled = {(r.ch_idx, r.src): r for r in out["filled"].collect()}
    assert len(filled) == 6 and all(r.text == f"[de] {r.src}" or r.src.startswith("3.") for r in filled.values())
    assert filled[0, "3. The end came."].text.startswith("3. ") and {r.level for r in filled.values()} == {"final"}
    assert {(r.outcome, r.n_empty, r.n_unaligned) for r in V.outcome(out["filled"]).collect()} == {("complete", 0, 0)}
    assert {r.ok for r in out["verdicts"].collect()} == {True}
    files = V.archives(out["filled"], "en", "de", str(tmp_path / "out")).collect()
    with open(files[0].file, "rb") as f:
        book = B.read_archive(f.read())
    assert [s["src"] for s in B.archive_sentences(book)][:2] == ["The red dog ran.", "It sat down!"] and book["chapters"][0]["paragraphs"][0][0]["tr"]["de"]["q"] == 0.8

    def never(items):
        calls.append(items)
        raise AssertionError

    again = V.run(spark, sentences, V.Options("en", "de", o.store, never, align=never, judge=never, terms=o.terms))
    assert again["filled"].where("text = ''").count() == 0
    keys = S.read_store(spark, o.store).where(F.col("text").contains("red dog")).select("key")
    assert S.invalidate(spark, o.store, keys) == 2 and S.invalidate(spark, o.store, keys) == 0
    third = V.run(spark, sentences, o)
    assert third["filled"].where("text = ''").count() == 0


def test_proofreading_has_its_own_keys(spark, sentences, tmp_path):
    seen = lambda items: {x["id"]: f"{x['text']} ({len(x['context'])})" for x in items if "dog" not in x["src"]}
    o = V.Options("en", "de", str(tmp_path / "s"), P.tagging_provider("de"), proofread=seen, context=2)
    texts = {r.src: (r.text, r.level) for r in V.run(spark, sentences, o)["filled"].collect()}
    assert texts["It sat down!"] == ("[de] It sat down! (1)", "raw") and texts["The red dog ran."][0] == "[de] The red dog ran." and texts["one"][0].endswith("(2)")
    with pytest.raises(ValueError):
        V.Options("en", "de", "x", seen, context=1)


def test_small_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('["x y", " ", "z"]')
    (tmp_path / "b.txt").write_text("x y\n\nz\n")
    assert {r.src for r in S.read_sources(spark, str(tmp_path / "a.json")).collect()} == {r.src for r in S.read_sources(spark, str(tmp_path / "b.txt")).collect()} == {"x y", "z"}
    (tmp_path / "p.json").write_text('[{"src": "a b", "expr": "b"}, {"src": "", "expr": "x"}]')
    assert [(r.src, r.expr) for r in S.read_probes(spark, str(tmp_path / "p.json")).collect()] == [("a b", "b")]
    assert S.read_probes(spark, str(tmp_path / "none.json")).count() == 0 and S.read_store(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "src string")
    S.write_flagged(df, str(tmp_path / "f"))
    assert [r.src for r in spark.read.json(str(tmp_path / "f")).orderBy("src").collect()] == ["a", "b"]
    m = spark.sql("select timestamp'2025-01-02 03:04:05.678' as ts, 'm' as model")
    S.append_metrics(m, str(tmp_path / "m"))
    S.append_metrics(m, str(tmp_path / "m"))
    assert [r.ts for r in spark.read.schema("ts string").json(str(tmp_path / "m")).collect()] == ["2025-01-02T03:04:05.678Z"] * 2

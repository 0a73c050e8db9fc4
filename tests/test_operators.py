import pytest
from pyspark.sql import functions as F

from tessella.operators import align as A
from tessella.operators import corpus as C
from tessella.operators import coverage as V
from tessella.operators import passes as P


def test_coverage(spark):
    df = spark.createDataFrame([("one two three", [(0, 3, [0]), (4, 7, [])], [(0, 2), (3, 5)], "en")], "text string, align array<struct<t0:int,t1:int,w:array<int>>>, words array<struct<s:int,e:int>>, target string")
    r = V.measure(df).first()
    assert (r.n_tgt, r.n_tgt_covered, r.n_src, r.n_src_tapped, r.n_chunks) == (3, 1, 2, 1, 2)
    assert r.q_runs == 0.33
    none = df.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast(df.schema["align"].dataType).alias("align"), F.lit(None).cast(df.schema["words"].dataType).alias("words"), F.lit("xx").alias("target"))
    assert V.measure(none).first().n_tgt == 0


def test_upper_median(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", None)], "g string, v double")
    assert df.where("g = 'a'").agg(V.upper_median("v").alias("m")).first().m == 3.0
    assert {r.g: r["median"] for r in V.ranked_median(df, ["g"], "v").collect()} == {"a": 3.0}


def test_mutual_best_and_glue(spark):
    sims = spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.1), (0, 1, 0, 0.8), (0, 1, 1, 0.2), (0, 2, 1, 0.7), (0, 2, 0, 0.1)], "p int, i int, j int, sim double")
    best = A.mutual_best(sims, "p")
    assert {(r.i, r.j) for r in best.collect()} == {(0, 0), (2, 1)}
    assert {(r.i, r.j) for r in A.glue(sims, best, "p").collect()} == {(1, 0)}


def test_chunks_drop_negative(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 2, 0), (1, 0, 0), (1, -1, 3)], "id int, s int, t int")
    assert [(r.t, r.w) for r in A.chunks(p, ["id"]).collect()] == [(0, [0, 2])]


def test_locate_and_echo():
    assert A.locate(["cat", "the"], "The cat, the end") == [(4, 7), (9, 12)]
    assert A.locate(["he"], "the he") == [(4, 6)]
    assert A.locate(["zzz", "end"], "The end") == [None, (4, 7)]
    assert A.resolve_echo(["1:cat", "the", "the", "the", "9:dog"], ["The", "cat", "the"]) == [1, 0, 2, 2]


def test_occurrence_match(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "src string, pos int")
    b = spark.createDataFrame([("x", 10), ("y", 11), ("y", 12)], "src string, pos int")
    m = C.matched(C.occurrences(a, "src", ["pos"]), C.occurrences(b, "src", ["pos"]), ["src", "occurrence"])
    assert {(r.pos, r.pos_b) for r in m.collect()} == {(1, 10), (3, 11)}
    same = C.matched(C.occurrences(a, "src", ["pos"]), C.occurrences(a, "src", ["pos"]), ["src", "occurrence"])
    assert same.where("pos <> pos_b").count() == 0 and same.count() == 3


def test_pending_and_rounds(spark):
    wanted = spark.createDataFrame([("k1", "one"), ("k1", "one"), ("k2", "two")], "key string, src string")
    store = spark.createDataFrame([("k1", "<eos>")], "key string, text string")
    assert {r.key for r in C.pending(wanted, store).collect()} == {"k1", "k2"}
    calls = {"k1": "eins", "k2": "zwei"}
    full = P.run_rounds(wanted, store, lambda items: {x["id"]: calls["k1" if x["src"] == "one" else "k2"] for x in items})
    assert {r.key: r.text for r in full.collect()} == calls
    assert C.pending(wanted, full).count() == 0
    assert P.invalidated(full, wanted.where("key = 'k1'")).count() == 1


def test_context_breaks_sections(spark):
    df = spark.createDataFrame([(1, i, f"s{i}", "" if i == 1 else f"t{i}") for i in range(4)], "b int, i int, src string, tr string")
    got = {r.i: [x.src for x in r.context] for r in C.previous_context(df, ["b"], ["i"], 2, "src", "tr").collect()}
    assert got == {0: [], 1: ["s0"], 2: ["s0"], 3: ["s2"]}
    p = spark.createDataFrame([(1, i, r) for i, r in enumerate(["sceneBreak", "body", "sceneBreak", "sceneBreak", "body", "sceneBreak"])], "b int, i int, role string")
    assert [r.i for r in C.without_loose_breaks(p, ["b"], ["i"], F.col("role") == "sceneBreak").orderBy("i").collect()] == [1, 2, 4]


def test_spans_and_marks(spark):
    sents = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 20)], "para int, sent_idx int, b int, f int")
    spans = spark.createDataFrame([(1, 5, 15, "i")], "para int, s int, e int, k string")
    assert {(r.sent_idx, r.s, r.e) for r in C.clipped_spans(spans, sents, "para").collect()} == {(0, 5, 10), (1, 0, 4)}
    marks = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (1, 99, "c")], "para int, pos int, id string")
    assert {(r.id, r.sent_idx, r.p) for r in C.marks_to_sentences(marks, sents, "para").collect()} == {("a", 0, 10), ("b", 1, 9), ("c", 1, 9)}


def test_support_plural_and_no_evidence(spark):
    lex = spark.createDataFrame([("word", "wort", 5, 1)], "s string, t string, n int, rank int")
    words = spark.createDataFrame([(1, 0, True, "words", "wortes"), (1, 1, True, "none", "xxx")], "id int, chunk int, own boolean, s string, t string")
    r = C.checked(words, lex, ["id"]).first()
    assert (r.n_covered, r.n_supported, r.n_shift_hits, r.reason) == (1, 1, 0, None)


def test_lexicon_by_hashes_equals_the_one_by_words(spark):
    import random

    rng = random.Random(2)
    words = ["a", "b", "cc", "dd", "ее", "é", ""]
    rows = [(rng.choice(["x", "y", ""]), sorted(set(rng.choices(words, k=4))), sorted(set(rng.choices(words, k=4)))) for _ in range(150)] + [("x", [], ["a"]), ("z", None, ["a"])]
    df = spark.createDataFrame(rows, "g string, ss array<string>, ts array<string>")
    pairs = df.select("g", F.explode("ss").alias("s"), "ts").select("g", "s", F.explode("ts").alias("t"))
    want = {tuple(r) for r in C.lexicon(pairs, top=3, by=("g",)).collect()}
    got = [tuple(r) for r in C.lexicon_of(df, top=3, by=("g",)).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert C.lexicon_of(df.where("false"), by=("g",)).count() == 0
    assert {tuple(r) for r in C.lexicon_of(df).collect()} == {tuple(r) for r in C.lexicon(pairs).collect()}


def test_places_within_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(900)] + [(None, 7), (None, 3)]
    df = spark.createDataFrame(rows, "k string, i int")
    got: dict = {}
    for r in C.within(df, ["k"], ["i"], "nth").collect():
        got.setdefault(r.k, []).append((r.nth, r.i))
    for k, x in got.items():
        assert [i for _, i in sorted(x)] == sorted(i for key, i in rows if key == k) and [n for n, _ in sorted(x)] == list(range(len(x)))
    assert {r.batch for r in C.batches(df.where("k = 'hot'"), ["k"], ["i"], 100).collect()} == set(range(6))
    assert C.within(df.where("false"), ["k"], ["i"], "nth").count() == 0


def test_sentence_ranges(spark):
    df = spark.createDataFrame([(1, "He left. She ran! “Who?” Then"), (2, "one"), (3, "")], "id int, text string")
    got = {(r.id, r.sent_idx): (r.b, r.f) for r in C.sentence_ranges(df, "id").collect()}
    assert got == {(1, 0): (0, 9), (1, 1): (9, 18), (1, 2): (18, 25), (1, 3): (25, 29), (2, 0): (0, 3), (3, 0): (0, 0)}


def test_sign_test_and_small_folds():
    assert C.sign_test(27, 31) == pytest.approx(3.4e-05, rel=0.02)
    assert C.sign_test(0, 0) == 1.0
    meta: dict = {"other": 1}
    for i in range(50):
        meta = P.append_run(meta, {"at": i, "x": i // 2})
    assert meta["createdAt"] == 0 and meta["updatedAt"] == 49 and meta["other"] == 1
    assert len(meta["runs"]) == 20 and meta["runs"][-1] == {"at": 48, "x": 24} and meta["runs"][0] == {"at": 10, "x": 5}
    assert P.glossary_hash([]) == "" and len(P.glossary_hash([("a", "b")])) == 12
    assert P.echo_words(["a b", 3, "c"]) == ["a", "b", "c"] and P.echo_words(None) == []
    assert P.decode_reply('```json\n{"1": "x"}\n```') == {"1": "x"} and P.decode_reply("<think>x") is None
    assert P.decode_verdicts('[{"id": 1, "ok": true}]') == {"1": {"ok": True}}
    assert P.model_component("m", "ab", True, 2) == "m+g:ab+rp:c2"


def test_stride_and_global_numbers(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    got = [r.i for r in C.stride_sample(df, ["i"], 7).orderBy("i").collect()]
    assert got == [142 * k for k in range(7)]
    assert C.stride_sample(df.where("i < 0"), ["i"], 7).count() == 0


def test_quote_split():
    seg = lambda t: [p for p in __import__("re").split(r"(?<=[.!?]) (?=[A-Z])", t) if p]
    assert P.split_quoted("“Stop. Go!” He ran.", seg) == ["“Stop.", "Go!”", "He ran."]
    assert P.split_quoted("“Stop!” he said.", seg) == ["“Stop!” he said."]


def test_whole_table_of_vectors(spark, tmp_path):
    import numpy as np

    from tessella.plans.catalog import QUERIES

    vecs = np.random.default_rng(1).normal(size=(145, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(vecs)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    first, both, glued, seen = set(), set(), set(), 0
    for g in range(3):
        part = vecs[g * 48 : 145 if g == 2 else g * 48 + 48].astype(float)
        a, b = part[::2], part[1::2]
        seen += len(a) + len(b)
        sim = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
        best = lambda rows, cols: {(i, j) for i in rows for j in cols if sim[i, j] == max(sim[i, list(cols)]) == max(sim[list(rows), j])}  # noqa: B023, E731
        one = best(range(len(a)), range(len(b)))
        free = lambda k, n: [x for x in range(n) if x not in {p[k] for p in one}]  # noqa: B023, E731
        left, right = free(0, len(a)), free(1, len(b))
        two = {(i, j) for i, j in best(left, right) if sim[i, j] > 0} if left and right else set()
        stick = {("source", i, int(sim[i].argmax())) for i in left if sim[i].max() >= 0.1 and any(j == sim[i].argmax() and 1 <= abs(i - k) <= 3 for k, j in one)} | {("target", int(sim[:, j].argmax()), j) for j in right if sim[:, j].max() >= 0.1 and any(i == sim[:, j].argmax() and 1 <= abs(j - k) <= 3 for i, k in one)}
        first |= {(g, *x) for x in one}
        both |= {(g, *x) for x in one | two}
        glued |= {(g, side, *x) for side, *x in stick}
    assert seen == 145 and glued
    for name, want in (("mutual_argmax", first), ("iterated_argmax", both), ("glued_words", glued)):
        got = [(r.pair, r.side, r.i, r.j) if name == "glued_words" else (r.pair, r.i, r.j) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert set(got) == want and len(got) == len(want), name


def test_shift_hits(spark):
    words = ["red", "house", "green", "garden", "river"]
    to = ["rot", "haus", "gruen", "garten", "fluss"]
    src, text = " ".join(words), " ".join(to)
    place = lambda ws: [(sum(len(x) + 1 for x in ws[:i]), sum(len(x) + 1 for x in ws[:i]) + len(w)) for i, w in enumerate(ws)]
    t = place(to)
    whole = [(*t[i], [i]) for i in range(5)]
    late = [(*t[i], [i] if i < 3 else [i + 1 if i == 3 else 3]) for i in range(5)]  # the last two changed places
    two = [(*t[1], [0]), (*t[2], [1])]  # two links, one word early each
    bad = [(*t[(i + 2) % 5], [i]) for i in range(5)]
    rows = [("clean", src, text, place(words), whole), ("late", src, text, place(words), late), ("two", src, text, place(words), two), ("far", src, text, place(words), bad), ("none", src, text, place(words), [(0, 99, [0]), (0, 3, [9]), (0, 3, [])])]
    df = spark.createDataFrame(rows, "id string, src string, text string, words array<struct<s:int,e:int>>, align array<struct<t0:int,t1:int,w:array<int>>>")
    lex = spark.createDataFrame([(a, b, 5, 1) for a, b in zip(words, to)], "s string, t string, n int, rank int")
    got = {r.id: (r.n_covered, r.n_supported, r.n_shift_hits, r.reason) for r in C.checked(C.chunk_words(df, F.col("align"), ["id"]), lex, ["id"]).collect()}
    assert got["clean"] == (5, 5, 0, None)
    assert got["late"] == (5, 3, 2, "shift-pattern") and got["two"] == (2, 0, 2, "shift-pattern")
    assert got["far"][:2] == (5, 0) and got["far"][3] == "low-support"
    assert "none" not in got or got["none"][0] == 0


def test_every_target(spark, tmp_path):
    from tessella.plans.catalog import QUERIES

    at = __import__("datetime").datetime(2025, 1, 1)
    pos = lambda t: [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+", t)]
    src = {1: ("gato verde", "es"), 2: ("green house", "en"), 3: ("green house", None)}
    words = "array<struct<s:int,e:int>>"
    align = "array<struct<t0:int,t1:int,w:array<int>>>"
    spark.createDataFrame([(b, x) for b, (_, x) in src.items()], "book_id long, language string").write.parquet(f"{tmp_path}/books.parquet")
    sents = [(b * 10 + i, b, 0, 0, i, t, pos(t), at) for b, (t, _) in src.items() for i in range(3)]
    spark.createDataFrame(sents, f"sentence_id long, book_id long, ch_idx int, para_idx int, sent_idx int, src string, words {words}, loaded_at timestamp").write.parquet(f"{tmp_path}/sentences.parquet")
    to = {"uk": "кіт зелений", "lt": "katė žalia"}
    tr = [(k * 100 + i[0], i[0], g, t, [(*pos(t)[0], [0])], at, at) for k, (g, t) in enumerate(to.items()) for i in sents if g == "uk" or i[1] != 3]
    spark.createDataFrame(tr, f"translation_id long, sentence_id long, target string, text string, align {align}, stored_at timestamp, loaded_at timestamp").write.parquet(f"{tmp_path}/translations.parquet")
    q = lambda n: QUERIES[n](spark, str(tmp_path)).collect()
    lex = {(r.source_lang, r.target, r.s) for r in q("lexicon_build")}
    assert {x[:2] for x in lex} == {("es", "uk"), ("es", "lt"), ("en", "uk"), ("en", "lt"), ("", "uk")} and ("es", "uk", "green") not in lex
    assert len(q("lexicon_checked")) == len(tr)
    assert q("pending_work") == []
    levels = {(r.target, r.raw_target): (r.level, r.n) for r in q("filled_levels")}
    assert levels == {("uk", "lt"): ("final", 2), ("lt", "uk"): ("final", 2)}
    ctx = {(r.sentence_id, r.target): r.n_context for r in q("previous_sentences")}
    assert ctx == {(b * 10 + i, g): i for b in src for g in to for i in (1, 2) if g == "uk" or b != 3}


def test_titles_of_any_script(spark, tmp_path):
    from tessella.plans.catalog import QUERIES

    titles = {1: ("Élan’s End", "elan’s end"), 2: ("Тёмный Лес", "тёмный лес"), 3: ("雪国", "雪国"), 4: ("बड़ा घर", "बड़ा घर"), 5: ("ביתו", "ביתו"), 6: ("บ้าน — Ü", "บ้าน — u"), 7: ("", ""), 8: (None, None)}
    spark.createDataFrame([(k, t) for k, (t, _) in titles.items()], "book_id long, title string").write.parquet(f"{tmp_path}/books.parquet")
    assert {r.book_id: r.folded for r in QUERIES["folded_titles"](spark, str(tmp_path)).collect()} == {k: v for k, (_, v) in titles.items() if v is not None}


def test_scores_and_local_coverage(spark):
    from tessella.operators import quality as Q

    pos = lambda t: [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+", t)]
    rows = [("en", "de", "der rote Hund", [(4, 8, [1]), (9, 13, [])], "the red dog", pos("the red dog")), ("xx", "yy", None, None, None, None), ("en", "de", "", [], "", [])]
    df = spark.createDataFrame(rows, f"source_lang string, target string, text string, align {Q.ALIGN}, src string, words {Q.WORDS}")
    a, b, c = Q.scores(df).collect()
    assert (round(a.cov_all, 3), a.cov_content, round(a.tap_all, 3), a.tap_content) == (0.667, 1.0, 0.333, 0.5)
    assert a.uncovered_src == ["dog"] and a.uncovered_tgt == []
    assert (b.cov_all, b.tap_content, c.cov_content) == (-1.0, -1.0, -1.0) and b.uncovered_src == []
    got = [r.q for r in df.select(Q.local_coverage(F.coalesce("text", F.lit("")), F.col("align")).alias("q")).collect()]
    assert got == [0.5, 0.0, 0.0]
    q = Q.content_q(df.select("target", "text", "align")).collect()
    assert (round(q[0].q_all, 3), q[0].q_content, q[1].q_all) == (0.333, 0.5, 0.0)
    left = df.limit(1).select(Q.content_chunks(F.col("text"), F.array(F.struct(F.lit(0).alias("t0"), F.lit(3).alias("t1"), F.array(F.lit(0)).alias("w")), F.struct(F.lit(4).alias("t0"), F.lit(8).alias("t1"), F.array(F.lit(1)).alias("w"))), F.col("target")).alias("x")).first().x
    assert [(c.t0, c.t1) for c in left] == [(4, 8)]


def test_probes(spark):
    from tessella.operators import quality as Q

    pos = lambda t: [(m.start(), m.end()) for m in __import__("re").finditer(r"\w+", t)]
    src, text = "he kept the bit in hand", "er hielt sie immer in Zaum fest"
    t = pos(text)
    case = lambda expr, w: (expr, "de", text, [(*t[i], x) for i, x in w], src, pos(src))
    rows = [
        case("kept the", [(1, [1]), (2, [2])]), case("Kept THE", [(1, [1])]), case("in hand", [(0, [0])]), case("not here", []), case("kept the", [(1, [1]), (6, [2])]),
        case("in hand", [(3, [4]), (5, [5])]), case("kept the", [(0, [1]), (1, []), (2, []), (3, []), (4, [2])]),
    ]
    df = spark.createDataFrame(rows, f"expr string, target string, text string, align {Q.ALIGN}, src string, words {Q.WORDS}")
    got = [(r.verdict, r.fragments) for r in Q.probes(df).collect()]
    assert [v for v, _ in got] == ["unit", "partial", "unaligned", "expr-not-found", "partial", "unit", "partial"]  # "in" may stand between
    assert got[0][1] == ["hielt", "sie"]


def test_judging(spark):
    from tessella.operators import quality as Q

    rows = [("a", 0.9, True), ("a", 0.9, False), ("b", 0.5, False), ("b", 0.9, None)] + [(f"c{i}", 0.8, False) for i in range(41)]
    scope = {r.src: r.why for r in Q.judge_scope(spark.createDataFrame(rows, "src string, q double, flagged boolean")).collect()}
    assert scope["a"] == "flagged" and scope["b"] == "low" and sum(w == "sample" for w in scope.values()) == 3 and len(scope) == 5
    v = spark.createDataFrame([("a", False, " drift "), ("a", False, ""), ("b", True, "x"), ("c", None, None), ("d", False, "z" * 99)], "src string, ok boolean, why string")
    t = Q.verdict_tally(v).first()
    assert (t.n_checked, t.n_flagged, t.n_unjudged, t.n_flagged_srcs) == (5, 3, 1, 2)
    assert {r.why: r.n for r in Q.verdict_reasons(v).collect()} == {"drift": 1, "unspecified": 1, "z" * 60: 1}
    df = spark.createDataFrame([("red dog", [(0, 3), (4, 7)], "roter Hund", [(0, 5, [0]), (6, 99, [1, 7]), (3, 3, [0]), (5, 6, [])])], f"src string, words {Q.WORDS}, text string, align {Q.ALIGN}")
    assert df.select(Q.align_pairs(*[F.col(c) for c in ("src", "words", "text", "align")]).alias("p")).first().p == [["roter", "red"], ["Hund", "dog"], [" ", ""]]


def test_passes_of_stand_ins(spark):
    wanted = spark.createDataFrame([("k1", "the red dog", [(0, 3), (4, 7), (8, 11)]), ("k2", "m 3m", [(0, 1), (3, 4)])], "key string, src string, words array<struct<s:int,e:int>>")
    both = wanted.join(P.run_pass(wanted, P.tagging_provider("de")), "key")
    got = {r.key: r for r in P.run_align(both, P.echoing_aligner()).collect()}
    assert [(c.t0, c.t1, c.w) for c in got["k1"].align] == [(5, 8, [0]), (9, 12, [1]), (13, 16, [2])] and got["k1"].q == 0.75
    assert "k2" not in got  # its second word stands inside another run, so it cannot be located
    odd = lambda items: {"1": [{"tgt": "dog", "src": ["the", 3, "dog"]}, {"tgt": "?!", "src": "red"}], "x": 3, "9": []}
    one = P.run_align(both.where("key = 'k1'"), odd).collect()
    assert [(c.t0, c.t1, c.w) for c in one[0].align] == [(13, 16, [0, 2])]

    def broken(items):
        raise RuntimeError("down")

    assert P.run_align(both, broken).count() == 0
    todo = both.select("key", "src", "text", F.array().cast("array<struct<src:string,tr:string>>").alias("context"), F.array().cast("array<array<string>>").alias("pairs"))
    assert {r.key: r.text for r in P.run_proofread(todo, lambda xs: {x["id"]: x["text"].upper() if len(x["src"]) > 5 else " " for x in xs}).collect()} == {"k1": "[DE] THE RED DOG"}
    assert {r.key: (r.ok, r.why) for r in P.run_judge(todo, lambda xs: {x["id"]: {"ok": False, "why": "w"} if x["src"][0] == "t" else None for x in xs}).collect()} == {"k1": (False, "w")}
    assert {r.key: r.text for r in P.frozen(both.select("key", "text"), spark.createDataFrame([("k1", "neu")], "key string, text string")).collect()} == {"k1": "neu", "k2": "[de] m 3m"}
    redo = lambda x: x.select("key", F.concat("text", F.lit("!")).alias("text"))
    verify = lambda x: x.select("key", (F.col("text").endswith("!!") & (F.col("key") == "k1")).alias("ok"))
    assert {r.key: (r.text, r.stripped) for r in P.escalated(todo, redo, verify).collect()} == {"k1": ("[de] the red dog!!", False), "k2": ("[de] m 3m!!", True)}


def test_glossary_and_phases(spark):
    sample = spark.createDataFrame([("wonderful lighthouse",), ("a lighthouse",)], "src string")
    assert [(r.src, r.tgt) for r in P.glossary(sample, P.long_words_glossary("de")).collect()] == [("lighthouse", "[de] lighthouse"), ("wonderful", "[de] wonderful")]
    assert P.glossary(sample, lambda s: [{"src": " ", "tgt": "x"}, {"src": "a", "tgt": None}]).count() == 0
    scope = {"source": "en", "target": "de", "title": "T", "author": "A", "sentences": 2}
    text = P.glossary_file(scope, [{"src": "a ", "tgt": "b"}, {"src": "c", "tgt": ""}])
    assert P.read_glossary(text, scope) == [{"src": "a", "tgt": "b"}]
    for k in scope:
        with pytest.raises(ValueError):
            P.read_glossary(text, scope | {k: "other"})
    rows = [("f", "r", None), (None, None, None), (None, "<eos>", "p"), (None, "r", None), (None, "r", "p"), ("<pad>", "r", "p")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r.p for r in df.select(P.phase(F.col("a"), F.col("b"), F.col("c")).alias("p")).collect()] == ["done", "translate", "translate", "proofread", "align", "align"]


def test_encoder_alignment_against_the_relational_form(spark):
    import numpy as np

    from tessella.operators import encode as E

    rng = np.random.default_rng(4)
    enc = E.hashed_encoder()
    words = ["red", "dog", "house", "garden", "dogs", "reds", "gardens", "the", "a", "an"]
    for _ in range(20):
        a, b = [str(x) for x in rng.choice(words, rng.integers(1, 9))], [str(x) for x in rng.choice(words, rng.integers(1, 9))]
        sim = E.similarity(enc(a), enc(b))
        best = {(i, j) for i in range(len(a)) for j in range(len(b)) if j == min(range(len(b)), key=lambda k: (-sim[i, k], k)) and i == min(range(len(a)), key=lambda k: (-sim[k, j], k))}
        assert E.best_pairs(sim, 1) == best
        free = [(i, j) for i in range(len(a)) for j in range(len(b)) if i not in {x for x, _ in best} and j not in {y for _, y in best}]
        assert all(p in free and sim[p] > 0 for p in E.best_pairs(sim) - best)
        for i, j in E.glue_pairs(sim, best) - best:
            assert sim[i, j] >= 0.3 and any((k, j) in best and 1 <= abs(k - i) <= 3 for k in range(len(a))) or any((i, k) in best and 1 <= abs(k - j) <= 3 for k in range(len(b)))
    assert E.align_words(enc, ["", "dog", " "], ["dog"]) == [(1, 0)] and E.align_words(enc, [], ["x"]) == []
    assert E.unit_pairs({(0, 0), (1, 5), (2, 7)}, [(0, 2)]) == {(0, 0), (0, 5), (1, 0), (1, 5)} and E.unit_pairs({(0, k) for k in range(5)}, [(0, 1)]) == set()


def test_embedding_pass(spark):
    from tessella.operators import encode as E
    from tessella.operators import quality as Q

    rows = [(1, "xx", "red dog", [(0, 3), (4, 7)], "red dog"), (2, "xx", "red", [(0, 3)], "zzz www vvv"), (3, "xx", "", [], ""), (4, "xx", "boom", [(0, 4)], "boom"), (5, "xx", "a", [(0, 1)], None)]
    df = spark.createDataFrame(rows, f"id long, target string, src string, words {Q.WORDS}, text string")

    def make():
        enc = E.hashed_encoder()

        def encode(ws):
            if "boom" in ws:
                raise RuntimeError("dead")
            return enc(ws)

        return encode

    got = {r.id: r for r in E.embed_align(df, make, ["id"]).collect()}
    assert [(c.t0, c.t1, c.w) for c in got[1].align] == [(0, 3, [0]), (4, 7, [1])] and got[1].q == 1.0 and got[1].accepted
    assert not got[2].accepted and got[3].align == [] and not got[3].accepted and got[4].align is None and not got[4].accepted and not got[5].accepted
    flagged = E.embed_align(df, make, ["id"], flagged=df.where("id = 1").select("id")).where("id = 1").first()
    assert not flagged.accepted
    p = spark.createDataFrame([([(0, 0), (2, 0), (0, 0), (-1, 1), (1, 9)], [(0, 3), (4, 7)])], f"p {E.PAIRS}, t {Q.WORDS}")
    assert [(c.t0, c.w) for c in p.select(E.chunked(F.col("p"), F.col("t")).alias("x")).first().x] == [(0, [0, 2])]


def test_providers():
    from tessella.operators import providers as X

    waits, calls = [], []

    def ask(items):
        calls.append(1)
        if len(calls) < 3:
            raise X.Failed(429, retry_after=7.0 if len(calls) == 1 else None)
        return {"1": "ok"}

    assert X.with_retries(ask, sleep=waits.append)([]) == {"1": "ok"} and waits[0] == 7.0 and 2.0 <= waits[1] <= 2.5
    with pytest.raises(X.Failed):
        X.with_retries(lambda _: (_ for _ in ()).throw(X.Failed(404)), sleep=waits.append)([])
    assert [X.backoff(k, jitter=lambda: 0) for k in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert X.ends_run(X.Exhausted()) and X.ends_run(X.Failed(401)) and not X.ends_run(X.Failed(503)) and not X.ends_run(ValueError())
    assert X.without_secrets({"HOME": "/", "api_key": "x", "MY_TOKEN": "y"}) == {"HOME": "/"}
    assert "from English to xx" in X.prompt("translate", "en", "xx") and X.prompt("translate", "en", "de", [{"src": "a", "tgt": "b"}]).endswith("- a = b") and "a = b" not in X.prompt("judge", "en", "de", [{"src": "a", "tgt": "b"}])
    r = X.provenance("t", "p", "q", {"translate": ("m", "v1"), "judge": None}, {"batch": 8, "store": "/secret", "rounds": None})
    assert r == {"at": "t", "producer": "p", "provider": "q", "passes": {"translate": {"model": "m", "version": "v1"}}, "options": {"batch": 8}}
    assert X.merged_meta({"a": 1, "runs": 0}, {"runs": []}) == {"a": 1, "runs": []}

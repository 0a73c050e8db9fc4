import io
import zipfile

from tessella.sources import books as B
from tessella.sources.html import blocks


def test_html_blocks():
    got = blocks("<html><head><title>x</title></head><body><h2>One</h2><p>An <i>old <b>man</b></i> left.<sup><a href='n.html#f1'>1</a></sup></p><script>no</script><hr><p class='subtitle'>Sub</p><img src='a.png' alt='Pic'><p>un<br>closed")
    assert [(b["role"], b["text"]) for b in got] == [("heading", "One"), ("body", "An old man left."), ("sceneBreak", ""), ("subtitle", "Sub"), ("figure", ""), ("body", "un closed")]
    assert got[4]["image"] == "a.png" and got[4]["alt"] == "Pic"
    assert got[1]["marks"] == [{"pos": 16, "id": "n.html#f1", "label": "1"}]
    assert {(s["s"], s["e"], s["k"]) for s in got[1]["spans"]} == {(3, 10, "i"), (7, 10, "b")}
    assert blocks(None) == [] and blocks("") == []


def epub(docs: dict[str, str], spine: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in docs)
        z.writestr("O/c.opf", f'<package xmlns:dc="d"><metadata><dc:title>T</dc:title><dc:creator> </dc:creator><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in spine)}</spine></package>')
        for n, h in docs.items():
            z.writestr(f"O/{n}.xhtml", h)
    return out.getvalue()


def test_epub(spark, tmp_path):
    data = epub({"toc": "<p>Contents</p>", "copyright": "<p>(c)</p>", "a": "<h1>A</h1><hr/><p>One.</p><hr/><hr/><p>Two.</p><hr/>", "b": "<p>Three.</p>"}, ["copyright", "a", "b", "missing"])
    (tmp_path / "x.epub").write_bytes(data)
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    rows = B.read_epub(spark, str(tmp_path / "*.epub")).collect()
    good = sorted((r for r in rows if r.error is None), key=lambda r: (r.ch_idx, r.para_idx))
    assert [(r.ch_idx, r.role, r.text) for r in good] == [(0, "body", "One."), (0, "sceneBreak", ""), (0, "body", "Two."), (1, "body", "Three.")]
    assert (good[0].title, good[0].author, good[0].chapter) == ("T", "Unknown", "A")
    assert sum(r.error is not None for r in rows) == 1


def test_fb2_charset_and_zip():
    xml = '<?xml version="1.0" encoding="windows-1251"?><FictionBook><description><title-info><author><first-name>Лук</first-name><last-name>Я</last-name></author><book-title>Кн</book-title><lang>ru</lang></title-info></description><body><section><title><p>Гл</p></title><p>Раз <emphasis>два</emphasis></p><empty-line/><section><title><p>Под</p></title><p>Три</p></section></section></body><body name="notes"><section><p>нет</p></section></body></FictionBook>'.encode("cp1251")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("b.fb2", xml)
    for data in (xml, z.getvalue()):
        rows = B.parse_fb2(data, "b.fb2.zip")
        assert [(r[7], r[8]) for r in rows] == [("body", "Раз два"), ("sceneBreak", ""), ("heading", "Под"), ("body", "Три")]
        assert rows[0][1:4] == ("Кн", "Лук Я", "ru") and rows[0][9] == [{"s": 4, "e": 7, "k": "i"}]


def test_archive_round_trip():
    book = {"title": "T", "author": "A", "sourceLang": "en", "targetLangs": ["ru"], "chapters": [{"title": "C", "paragraphs": [[{"src": "a"}], [{"src": "<b>"}]], "styles": ["heading"]}]}
    assert B.read_archive(B.write_archive(book)) == book
    assert B.trimmed_styles(["body", "heading", "body"], 3) == ["body", "heading"] and B.trimmed_styles(["body"], 2) == []


def test_tables_figures_and_what_is_left_out():
    page = """<body><div class="pg-boilerplate"><p>license</p></div><div class="title"><p>T</p></div><p class="footnote">body of a note</p>
    <table><tr><th>A</th><td class="x_cab">B</td></tr><tr><td> </td></tr><tr><td>1<table><tr><td>in</td></tr></table></td><td>2</td></tr></table>
    <figure><img src="a%20b.png"/><figcaption>Cap <b>x</b></figcaption></figure><div class="image"><img src="c.png"/><p class="imagefoot">Foot</p></div><div><img src="data:xx"/></div>
    <div class="title2">Second</div>loose <em>text</em><p>He <b>a<i>b</i></b> <a href="n.html#x" class="noteref">*</a> <a href="u.html#y">link</a></p></body>"""
    got = blocks(page)
    assert [(b["role"], b["text"]) for b in got] == [("table", ""), ("figure", "Cap x"), ("figure", "Foot"), ("heading", "Second"), ("body", "loose text"), ("body", "He ab link")]
    assert [[(c["text"], c["header"]) for c in row] for row in got[0]["rows"]] == [[("A", True), ("B", True)], [("1in", False), ("2", False)]]
    assert got[1]["image"] == "a b.png" and got[1]["spans"] == [{"s": 4, "e": 5, "k": "b"}] and got[3]["boundary"]
    assert {(x["s"], x["e"], x["k"]) for x in got[5]["spans"]} == {(3, 5, "b"), (4, 5, "i")} and [m["id"] for m in got[5]["marks"]] == ["n.html#x"]


def test_epub_notes_cover_and_bad_contents(spark, tmp_path):
    a = "<h1>A</h1><p>One.<sup><a href='n.xhtml#f1'>1</a></sup> Two.<sup><a href='n.xhtml#f2'>2</a></sup> Again.<sup><a href='n.xhtml#f1'>1</a></sup> Lost.<sup><a href='n.xhtml#no'>3</a></sup></p><img src='p.jpg'/>"
    n = "<div id='f1'><p><a href='a.xhtml'>x</a>. First <i>note</i>.</p><p>More.</p></div><p><a id='f2' href='a.xhtml#r'>2</a>) Vell, J., Salt, P., Press, 1874, see http://x.</p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package><metadata><meta name="cover" content="cv"/></metadata><manifest><item id="a" href="a.xhtml"/><item id="n" href="n.xhtml"/><item id="p" href="p.jpg" media-type="image/jpeg"/><item id="cv" href="c.jpg" media-type="image/jpeg"/><item id="t" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="n"/></spine></package>')
        z.writestr("O/t.ncx", "<broken")
        z.writestr("O/a.xhtml", a)
        z.writestr("O/n.xhtml", n)
        z.writestr("O/p.jpg", b"P")
        z.writestr("O/c.jpg", b"C")
    (tmp_path / "x.epub").write_bytes(out.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"?")
    book = B.open_epub(out.getvalue(), "x.epub")
    assert [b["role"] for _, bs in book["chapters"] for b in bs] == ["body", "figure"] and book["images"] == {"O/p.jpg": b"P"} and book["title"] == "x"
    assert [(m["id"], m["label"], m["pos"]) for m in book["chapters"][0][1][0]["marks"]] == [("n1", "1", 4), ("n2", "2", 9), ("n1", "1", 16)]
    rows = [r for r in B.read_epub_notes(spark, str(tmp_path / "*.epub")).collect() if r.error is None]
    assert [(r.id, r.kind, r.para_idx, r.text) for r in rows] == [("n1", "note", 0, "x. First note."), ("n1", "note", 1, "More."), ("n2", "citation", 0, "Vell, J., Salt, P., Press, 1874, see http://x.")]
    assert {r.cover and bytes(r.cover) for r in B.read_covers(spark, str(tmp_path / "*.epub")).collect()} == {b"C", None}


def test_whole_archive():
    s = {"src": "a b", "words": None, "tr": {"de": {"text": "x y z w", "align": [{"t": [0, 1], "w": [0]}, {"t": [2, 3], "w": []}, {"t": [4, 7], "w": [1]}]}, "fr": {"text": "", "align": None}}}
    book = {"title": "T", "author": "A", "sourceLang": "en", "targetLangs": ["de"], "chapters": [{"title": "", "paragraphs": [[s]], "tables": [{"rows": [[{"sentences": [{"src": "c"}]}]]}], "figures": [{"image": "i.png", "caption": [{"src": "cap"}]}]}], "notes": [{"id": "n10", "kind": "note", "paragraphs": [[{"src": "ten"}]]}, {"id": "n2", "kind": "note", "paragraphs": [[{"src": "two"}]]}, {"id": "n1", "kind": "citation", "paragraphs": [[{"src": "cite"}]]}], "images": {"images/b": b"2", "images/a": b"1"}, "cover": b"C", "meta": {"runs": []}}
    data = B.write_archive(book)
    names = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert names == ["chapters/ch1.json", "notes.json", "images/a", "images/b", "cover.jpg", "manifest.json"]
    got = B.read_archive(data)
    tr = got["chapters"][0]["paragraphs"][0][0]["tr"]
    assert got["chapters"][0]["title"] == "Chapter 1" and tr["de"]["q"] == 0.75 and tr["fr"] == {"text": "", "align": [], "q": 0.0} and got["cover"] == b"C" and got["images"]["images/a"] == b"1" and got["meta"] == {"runs": []}
    assert [(x["kind"], x["src"]) for x in B.archive_sentences(got)] == [("prose", "a b"), ("prose", "cap"), ("prose", "c"), ("note", "two"), ("note", "ten"), ("citation", "cite")]


def test_image_headers(spark):
    import struct

    from tessella.sources import images as I

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 1500, 20)
    gif = b"GIF89a" + struct.pack("<HH", 30, 40)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 60) + b"\0" * 12
    assert [I.probe(x) for x in (png, gif, jpeg, b"", None, b"\xff\xd8no", b"text")] == [("png", 1500, 20), ("gif", 30, 40), ("jpeg", 60, 50), None, None, None, None]
    df = spark.createDataFrame([("a", png), ("b", gif), ("c", None)], "path string, content binary")
    assert [(r.path, r.format, r.width, r.keep) for r in I.probed(df).orderBy("path").collect()] == [("a", "png", 1500, False), ("b", "gif", 30, True), ("c", None, None, False)]

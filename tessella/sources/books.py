"""Books as files: EPUB and FB2 (plain or zipped) to paragraph rows, and the engine's own archive, read and written.

Every file is read by one task from ``binaryFile``; rows carry the file's path. A file that cannot be read gives one row
with its error and no text, so that one broken book does not end a job.
"""

from __future__ import annotations

import base64
import io
import json
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from tessella.functions.text import ACCENTED, MATTER_EXACT, MATTER_LOOSE, PLAIN, URL, YEAR
from tessella.sources.html import blocks, note_body, squeeze, tree

PARAGRAPHS = "path string, title string, author string, language string, ch_idx int, chapter string, para_idx int, role string, text string, spans array<struct<s:int,e:int,k:string>>, marks array<struct<pos:int,id:string,label:string>>, cell struct<r:int,c:int,header:boolean>, image string, alt string, error string"
NOTES = "path string, id string, label string, kind string, para_idx int, text string, spans array<struct<s:int,e:int,k:string>>, error string"
_FOLD = str.maketrans(ACCENTED, PLAIN)
_EXACT, _LOOSE = re.compile(MATTER_EXACT), re.compile(MATTER_LOOSE)


def is_matter(title: str) -> bool:
    """As functions.text.is_matter, for one title."""
    folded = title.lower().translate(_FOLD)
    return bool(folded) and bool(_EXACT.match(folded) or _LOOSE.search(folded))


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _all(node, name: str):
    return [x for x in node.iter() if _local(x.tag) == name]


def _text(node) -> str:
    return squeeze("".join(node.itertext()))[0]


def _first(node, name: str) -> str:
    return next((t for x in _all(node, name) if (t := _text(x))), "")


def open_epub(data: bytes, path: str) -> dict:
    """An EPUB as a whole: title, author, language, chapters of blocks, notes, cover and the images that are shown.

    The spine in order; chapters by the table of contents where two of its files are found, else by each file and by the divisions
    whose class begins one; matter and files of notes skipped unless nothing else is left; leading and trailing breaks dropped, runs
    of them joined. Note markers get ids n1, n2, … in the order of their first reference, one a target; markers whose note is not
    found go. A table of contents that can't be read counts as none."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    root = next((x.get("full-path") for x in _all(ET.fromstring(z.read("META-INF/container.xml")), "rootfile")), None)
    if root not in names:
        raise ValueError("no root file")
    opf, base = ET.fromstring(z.read(root)), posixpath.dirname(root)
    at = lambda folder, href: posixpath.normpath(posixpath.join(folder, unquote(href.split("#")[0])))
    manifest = {x.get("id"): x for x in _all(opf, "item")}
    spine = [at(base, manifest[x.get("idref")].get("href")) for x in _all(opf, "itemref") if x.get("idref") in manifest]
    toc: dict[str, str] = {}
    ncx = next((at(base, x.get("href")) for x in manifest.values() if x.get("media-type") == "application/x-dtbncx+xml" or (x.get("href") or "").lower().endswith(".ncx")), None)
    if ncx in names:
        try:
            points = _all(ET.fromstring(z.read(ncx)), "navPoint")
        except ET.ParseError:
            points = []
        for point in points:
            src = next((x.get("src") for x in point if _local(x.tag) == "content"), None)
            label = next((_text(x) for x in point if _local(x.tag) == "navLabel"), "")
            if src:
                toc.setdefault(at(posixpath.dirname(ncx), src), label)
    by_toc = len(set(toc) & set(spine)) >= 2
    pages = {doc: tree(z.read(doc).decode("utf-8", "replace")) for doc in dict.fromkeys(spine) if doc in names}
    targets: dict[tuple[str, str], tuple[str, str]] = {}
    found = {doc: blocks(None, page) for doc, page in pages.items()}

    def marked(doc: str, marks: list[dict]) -> None:
        kept = []
        for m in marks:
            file, _, frag = m["id"].strip().partition("#")
            if frag:
                where = (at(posixpath.dirname(doc), file) if file else doc, frag)
                m["id"] = targets.setdefault(where, (f"n{len(targets) + 1}", m["label"]))[0]
                kept.append(m)
        marks[:] = kept

    chapters: list[tuple[str, list[dict]]] = []
    shown: list[str] = []
    for doc in spine:
        if doc not in pages:
            continue
        head = toc.get(doc) or next((b["text"] for b in found[doc] if b["role"] == "heading"), "")
        if any(doc == file for file, _ in targets) or is_matter(head) or is_matter(posixpath.splitext(posixpath.basename(doc))[0].replace("_", " ").replace("-", " ")):
            continue
        if not (by_toc and doc not in toc and chapters):
            chapters.append((head, []))
        for b in found[doc]:
            if b.get("boundary") and not by_toc:
                chapters.append((b["text"], []))
                continue
            for part in [b, *(c for row in b.get("rows") or [] for c in row)]:
                marked(doc, part["marks"])
            if b["role"] == "figure":
                b["image"] = at(posixpath.dirname(doc), b["image"])
                if b["image"] not in names:
                    continue
                shown.append(b["image"])
            chapters[-1][1].append(b)
    notes = []
    for (file, frag), (note, label) in targets.items():
        page = pages.get(file) or (tree(z.read(file).decode("utf-8", "replace")) if file in names else None)
        body = note_body(page, frag) if page is not None else []
        if body:
            notes.append({"id": note, "label": label, "kind": "citation" if is_citation(" ".join(p["text"] for p in body) + " ") else "note", "paragraphs": body})
    known = {n["id"] for n in notes}
    for _, bs in chapters:
        for b in bs:
            for part in [b, *(c for row in b.get("rows") or [] for c in row)]:
                part["marks"] = [m for m in part["marks"] if m["id"] in known]
    chapters = [(h, _breaks(_no_echo(h, b))) for h, b in chapters]
    full = [c for c in chapters if any(b["text"].strip() and b["role"] != "heading" or b["role"] in ("figure", "table") for b in c[1])]
    return {
        "title": _first(opf, "title") or re.sub(r"(?i)\.epub$", "", posixpath.basename(path)), "author": _first(opf, "creator") or "Unknown", "language": _first(opf, "language"),
        "chapters": full or chapters, "notes": notes, "cover": _cover(z, opf, manifest, base, names), "images": {n: z.read(n) for n in dict.fromkeys(shown)},
    }


def _cover(z: zipfile.ZipFile, opf, manifest: dict, base: str, names: set[str]) -> bytes | None:
    """The cover: marked so in the manifest, named in the metadata, an image called so, or else the first image."""
    where = lambda x: posixpath.normpath(posixpath.join(base, unquote(x.get("href") or "")))
    images = [x for x in manifest.values() if (x.get("media-type") or "").startswith("image/")]
    meta = next((x.get("content") for x in _all(opf, "meta") if (x.get("name") or "").lower() == "cover"), None)
    ranked = [x for x in manifest.values() if "cover-image" in (x.get("properties") or "")] + [manifest[k] for k in (meta,) if k in manifest] + [x for x in images if "cover" in (x.get("href") or "").lower()] + images
    return next((z.read(where(x)) for x in ranked if where(x) in names), None)


_URL, _YEAR = re.compile(URL), re.compile(YEAR)


def is_citation(text: str) -> bool:
    """As functions.text.is_citation, for one text."""
    return bool(_URL.search(text) or text.count(",") >= 3 and _YEAR.search(text))


def parse_epub(data: bytes, path: str) -> list[tuple]:
    """Paragraph rows of an EPUB; of a table one row a cell, of role 'cell'."""
    b = open_epub(data, path)
    return _rows(path, b["title"], b["author"], b["language"], b["chapters"])


def parse_epub_notes(data: bytes, path: str) -> list[tuple]:
    """Note rows of an EPUB: path, id, label, kind, para_idx, text, spans."""
    return [(path, n["id"], n["label"], n["kind"], k, p["text"], p["spans"], None) for n in open_epub(data, path)["notes"] for k, p in enumerate(n["paragraphs"])]


def _no_echo(title: str, found: list[dict]) -> list[dict]:
    """Leading headings that are part of the chapter's title go."""
    low, k = title.casefold(), 0
    while k < len(found) and found[k]["role"] == "heading" and found[k]["text"] and found[k]["text"].casefold() in low:
        k += 1
    return found[k:]


def _breaks(found: list[dict]) -> list[dict]:
    out: list[dict] = []
    for b in found:
        if b["role"] != "sceneBreak" or (out and out[-1]["role"] != "sceneBreak"):
            out.append(b)
    while out and out[-1]["role"] == "sceneBreak":
        out.pop()
    return out


def _rows(path, title, author, language, chapters) -> list[tuple]:
    out = []
    for c, (head, found) in enumerate(chapters):
        for i, b in enumerate(found):
            row = (path, title, author, language, c, head or f"Chapter {c + 1}", i)
            for r, cells in enumerate(b.get("rows") or []):
                out += [(*row, "cell", x["text"], x["spans"], x["marks"], {"r": r, "c": k, "header": x["header"]}, None, None, None) for k, x in enumerate(cells)]
            if b["role"] != "table":
                out.append((*row, b["role"], b["text"], b.get("spans", []), b.get("marks", []), None, b.get("image"), b.get("alt"), None))
    return out


def parse_fb2(data: bytes, path: str) -> list[tuple]:
    """Paragraph rows of an FB2, plain or zipped, in its declared character set. Notes bodies are skipped; nested sections come
    inline with their titles as headings."""
    root = ET.fromstring(_fb2_bytes(data))
    info = next(iter(_all(root, "title-info")), root)
    title = _first(info, "book-title") or re.sub(r"(?i)\.fb2(\.zip)?$", "", posixpath.basename(path))
    who = next(iter(_all(info, "author")), None)
    author = "" if who is None else " ".join(t for n in ("first-name", "last-name") if (t := _first(who, n))) or _first(who, "nickname")
    chapters: list[tuple[str, list[dict]]] = []
    for body in (x for x in root if _local(x.tag) == "body" and (x.get("name") or "").lower() not in ("notes", "comments")):
        sections = [x for x in body if _local(x.tag) == "section"] or [body]
        for s in sections:
            head = next((_text(x) for x in s if _local(x.tag) == "title"), "")
            found: list[dict] = []
            _section(s, found, True)
            chapters.append((head, found))
    return _rows(path, title, author or "Unknown", _first(info, "lang"), chapters)


def _section(node, out: list[dict], top: bool) -> None:
    for x in node:
        tag = _local(x.tag)
        if tag == "section":
            _section(x, out, False)
        elif tag == "title" and not top:
            out.append({"role": "heading", "text": _text(x)})
        elif tag == "subtitle":
            out.append({"role": "subtitle", "text": _text(x)})
        elif tag == "empty-line":
            out.append({"role": "sceneBreak", "text": ""})
        elif tag == "p" and _text(x):
            raw, spans = [], []
            _rich(x, raw, spans)
            text, place = squeeze("".join(raw))
            out.append({"role": "body", "text": text, "spans": [{"s": place[s], "e": place[min(e, len(place) - 1)], "k": k} for s, e, k in spans if place[s] < place[min(e, len(place) - 1)]]})


def _rich(node, raw: list[str], spans: list) -> None:
    raw.append(node.text or "")
    for x in node:
        start = sum(map(len, raw))
        _rich(x, raw, spans)
        kind = {"emphasis": "i", "strong": "b"}.get(_local(x.tag))
        if kind:
            spans.append((start, sum(map(len, raw)), kind))
        raw.append(x.tail or "")


def _fb2_bytes(data: bytes) -> bytes:
    """The book of a ZIP: its first .fb2, else its first file."""
    if data[:2] != b"PK":
        return data
    z = zipfile.ZipFile(io.BytesIO(data))
    return z.read(next((n for n in z.namelist() if n.lower().endswith(".fb2")), z.namelist()[0]))


def fb2_cover(data: bytes) -> bytes | None:
    root = ET.fromstring(_fb2_bytes(data))
    page = next(iter(_all(root, "coverpage")), None)
    image = None if page is None else next(iter(_all(page, "image")), None)
    href = "" if image is None else next((v for k, v in image.attrib.items() if k.endswith("href")), "").lstrip("#")
    found = next((x for x in _all(root, "binary") if x.get("id") == href), None)
    return None if found is None else base64.b64decode("".join((found.text or "").split()))


def _reader(parse, schema: str = PARAGRAPHS):
    def run(frames):
        import pandas as pd

        names = [c.split(" ")[0] for c in re.split(r", (?![^<]*>)", schema)]
        for f in frames:
            rows: list[tuple] = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += parse(bytes(content), path)
                except Exception as e:  # a broken file is a row, not the end of the job
                    rows.append((path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=names)

    return run


def read_epub(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(_reader(parse_epub), PARAGRAPHS)


def read_epub_notes(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(_reader(parse_epub_notes, NOTES), NOTES)


def read_covers(spark: SparkSession, glob: str) -> DataFrame:
    """path, cover, error: the cover image of every EPUB and FB2, null where there is none."""
    cover = lambda data, path: [(path, (open_epub(data, path)["cover"] if path.lower().endswith(".epub") else fb2_cover(data)), None)]
    schema = "path string, cover binary, error string"
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(_reader(cover, schema), schema)


def read_fb2(spark: SparkSession, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(_reader(parse_fb2), PARAGRAPHS)


def write_archive(book: dict) -> bytes:
    """book: title, author, sourceLang, targetLangs, chapters [{title, paragraphs [[sentence]], styles, figures, tables}], and where there
    are any notes [{id, label, kind, paragraphs}], images {name: bytes}, cover, meta. A ZIP of chapter files, notes, images by name,
    the cover and the manifest, which comes last. Trailing body styles are cut, a chapter of body alone has none; null words and
    alignments become empty, and every translation with a text gets its coverage q."""
    out = io.BytesIO()
    dump = lambda x, **k: json.dumps(x, ensure_ascii=False, **({"separators": (",", ":")} | k)).encode()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        refs = []
        for i, c in enumerate(book["chapters"], 1):
            styles = trimmed_styles(c.get("styles") or [], len(c["paragraphs"]))
            more = {k: c[k] for k in ("figures", "tables") if c.get(k)}
            for t in c.get("tables") or []:
                for row in t.get("rows") or []:
                    for cell in row:
                        _whole(cell.get("sentences") or [])
            body = {"paragraphs": [_whole(p) for p in c["paragraphs"]]} | ({"paragraphStyles": styles} if styles else {}) | more
            z.writestr(f"chapters/ch{i}.json", dump(body))
            refs.append({"id": f"ch{i}", "title": c.get("title") or f"Chapter {i}", "file": f"chapters/ch{i}.json"})
        manifest = {"formatVersion": 1} | {k: book.get(k) for k in ("title", "author", "sourceLang", "targetLangs")}
        if book.get("notes"):
            z.writestr("notes.json", dump([n | {"paragraphs": [_whole(p) for p in n["paragraphs"]]} for n in book["notes"]]))
            manifest["notes"] = "notes.json"
        for name in sorted(book.get("images") or {}):
            z.writestr(name, book["images"][name])
        if book.get("cover") is not None:
            z.writestr("cover.jpg", book["cover"])
            manifest["cover"] = "cover.jpg"
        if book.get("meta"):
            manifest["meta"] = book["meta"]
        z.writestr("manifest.json", dump(manifest | {"chapters": refs}, separators=None, indent=2))
    return out.getvalue()


_RUN = re.compile(r"[^\W_]+")


def _whole(sentences: list[dict]) -> list[dict]:
    for s in sentences:
        if "words" in s:
            s["words"] = s["words"] or []
        for tr in (s.get("tr") or {}).values():
            tr["align"] = tr.get("align") or []
            runs = [m.span() for m in _RUN.finditer(tr.get("text") or "")]
            hit = sum(any(c["w"] and c["t"][0] < e and a < c["t"][1] for c in tr["align"]) for a, e in runs)
            tr["q"] = int(100 * hit / len(runs) + 0.5) / 100 if runs else 0.0
    return sentences


def read_archive(data: bytes) -> dict:
    """The inverse of write_archive."""
    z = zipfile.ZipFile(io.BytesIO(data))
    m = json.loads(z.read("manifest.json"))
    chapters = []
    for c in m["chapters"]:
        body = json.loads(z.read(c["file"]))
        chapters.append({"title": c["title"], "paragraphs": body["paragraphs"], "styles": body.get("paragraphStyles") or []} | {k: body[k] for k in ("figures", "tables") if k in body})
    book = {k: m.get(k) for k in ("title", "author", "sourceLang", "targetLangs")} | {"chapters": chapters}
    if m.get("notes"):
        book["notes"] = json.loads(z.read(m["notes"]))
    if m.get("cover"):
        book["cover"] = z.read(m["cover"])
    if m.get("meta"):
        book["meta"] = m["meta"]
    images = {n: z.read(n) for n in z.namelist() if not (n.startswith("chapters/") or n in ("manifest.json", m.get("notes"), m.get("cover")))}
    return book | ({"images": images} if images else {})


def archive_sentences(book: dict) -> list[dict]:
    """The flat sentences of an archive: prose with captions and cells, then content notes, then citations; notes by their number."""
    out = []
    for c in book["chapters"]:
        out += [{"kind": "prose"} | s for p in c["paragraphs"] for s in p]
        out += [{"kind": "prose"} | s for f in c.get("figures") or [] for s in f.get("caption") or []]
        out += [{"kind": "prose"} | s for t in c.get("tables") or [] for row in t["rows"] for cell in row for s in cell.get("sentences") or []]
    number = lambda n: int("".join(filter(str.isdigit, n["id"])) or 0)
    for kind in ("note", "citation"):
        out += [{"kind": kind} | s for n in sorted(book.get("notes") or [], key=number) if n.get("kind", "note") == kind for p in n["paragraphs"] for s in p]
    return out


def trimmed_styles(styles: list[str], n: int) -> list[str]:
    full = [*styles, *["body"] * (n - len(styles))][:n]
    while full and full[-1] == "body":
        full.pop()
    return full


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A (gzipped) file of lines word TAB t1|t2|…: s, t, rank; lines without a word go."""
    from pyspark.sql import functions as F

    from tessella.functions.text import fold_letters

    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(fold_letters(F.element_at(parts, 1)).alias("s"), F.split(F.try_element_at(parts, F.lit(2)), "\\|").alias("ts"))
    return lines.where("s <> ''").select("s", F.posexplode("ts").alias("rank", "t")).select("s", F.trim("t").alias("t"), (F.col("rank") + 1).alias("rank")).where("t <> ''")


def write_archives(sentences: DataFrame, folder: str) -> DataFrame:
    """sentences: book_id, title, author, source_lang, targets, ch_idx, chapter, para_idx, role, sent_idx, sentence (JSON). One
    archive file a book in the shared folder; a book's rows meet in one task, as its file does. Returns book_id, file, bytes."""
    import os

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["ch_idx", "para_idx", "sent_idx"])
        chapters = []
        for (_, title), c in pdf.groupby(["ch_idx", "chapter"], sort=True, dropna=False):
            paras = [[json.loads(x) for x in p["sentence"]] for _, p in c.groupby("para_idx", sort=True)]
            chapters.append({"title": title, "paragraphs": paras, "styles": [p["role"].iloc[0] for _, p in c.groupby("para_idx", sort=True)]})
        r = pdf.iloc[0]
        data = write_archive({"title": r["title"], "author": r["author"], "sourceLang": r["source_lang"], "targetLangs": list(r["targets"]), "chapters": chapters})
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"book_{key[0]}.zip")
        with open(f"{name}.{os.getpid()}", "wb") as f:  # a retried task replaces the file as a whole
            f.write(data)
        os.replace(f"{name}.{os.getpid()}", name)
        return pd.DataFrame([(key[0], name, len(data))], columns=["book_id", "file", "bytes"])

    return sentences.groupBy("book_id").applyInPandas(run, "book_id bigint, file string, bytes bigint")

"""Problem 1: one canonical form for texts that look the same.

Method: a quick-check, in the spirit of the Unicode normalization quick-check properties, tells stable text from
unstable text. Stable texts are their own canonical form and never leave the JVM. In an unstable text only the runs of
unstable characters, each with the character before it as boundary context, are normalized and spliced back into the
unchanged rest. A last step brings look-alike letters of mixed scripts to the script of their word, or of the text.

Canonical form: NFC; full- and half-width forms, ligature letters and no-break hyphens folded; every single blank of any
width a space; zero-width and other invisible characters gone; outer white space gone. Superscripts, fractions, numero
signs, dots, quotes and dashes are visibly different and stay.

Defined results: null stays null; an empty text is empty; a text without letters has a form but makes no pair.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

# --- fixed values: blanks drawn as a space, and characters that are not drawn at all
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# --- fixed values: letters drawn like a Latin one, Latin first
LATIN_C, CYRILLIC = "aceopxyijsdhqwABEKMHOPCTXYIJSëïËÏ", "асеорхуіјѕԁһԛԝАВЕКМНОРСТХҮІЈЅёїЁЇ"
LATIN_G, GREEK = "ovABEZHIKMNOPTYX", "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"

CYR_TO_LAT, LAT_TO_CYR = str.maketrans(CYRILLIC, LATIN_C), str.maketrans(LATIN_C, CYRILLIC)
GRE_TO_LAT, LAT_TO_GRE = str.maketrans(GREEK, LATIN_G), str.maketrans(LATIN_G, GREEK)

#: Coarse classes for the JVM: whatever may be unstable lies in them. Few ranges, as Java tries them one by one.
COARSE = (
    "^\\s|\\s$|[\u00a0\u00ad\u0132\u0133\u0149\u01c4-\u01cc\u01f1-\u01f3\u0300-\u036f\u0483-\u0487\u0530-\u1fff"
    "\u2000-\u2012\u2028-\u202f\u205f-\u206f\u2126\u212a\u212b\u2e80-\u2fff\u3000\u302a-\u302f\u3099-\u309c\u3130-\u318f\uf900-\uffff]"
    "|[\\x{10000}-\\x{10FFFF}]"
)
CYR_UNIQUE = "[" + "".join(chr(c) for c in range(0x410, 0x460) if chr(c) not in CYRILLIC) + "]"


@lru_cache(1)
def _tables():
    """Fold table, and the class of unstable characters: what NFC may change or compose, and what is folded."""
    fold: dict[int, str] = {ord(c): " " for c in BLANKS} | {ord(c): "" for c in INVISIBLE} | {0x2010: "-", 0x2011: "-"}
    unstable: list[int] = []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp < 0xE000 or 0x20000 <= cp < 0x2F800 or 0xE1000 <= cp:
            continue
        c = chr(cp)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if cp not in fold and (kind in ("<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= cp <= 0xFB06 or 0x132 <= cp <= 0x133 or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3):
            fold[cp] = unicodedata.normalize("NFKC", c)
        if cp in fold or unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or 0x1161 <= cp <= 0x1175 or 0x11A8 <= cp <= 0x11C2 or cp in (0x9BE, 0x9D7, 0xB3E, 0xB56, 0xB57, 0xBBE, 0xBD7, 0xCC2, 0xCD5, 0xCD6, 0xD3E, 0xD57, 0xDCF, 0xDDF, 0x102E, 0x1B35):
            unstable.append(cp)
    ranges, start = [], None
    for cp in [*unstable, sys.maxunicode + 9]:
        if start is None:
            start = last = cp
        elif cp == last + 1:
            last = cp
        else:
            ranges.append(f"\\U{start:08x}-\\U{last:08x}")
            start = last = cp
    return fold, re.compile(f"[^\n]?[{''.join(ranges)}]+")


_WORD = re.compile(r"[^\W\d_]+")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
_UNIQUE = (
    re.compile("[" + "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.isalpha() and c not in LATIN_C + LATIN_G) + "]"),
    re.compile("[" + "".join(chr(c) for c in range(0x400, 0x530) if chr(c).isalpha() and chr(c) not in CYRILLIC) + "]"),
    re.compile("[" + "".join(chr(c) for c in range(0x370, 0x400) if chr(c).isalpha() and chr(c) not in GREEK) + "]"),
)
_MIXED = re.compile("[\u0370-\u052f]")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_BACK = ({}, LAT_TO_CYR, LAT_TO_GRE)


@lru_cache(65536)
def _run(text: str) -> str:
    return unicodedata.normalize("NFC", text.translate(_tables()[0]))


def _scripts(text: str) -> str:
    """Look-alike letters go to the script of their word's own letters, else of the text's, else to Latin."""
    counts = [len(u.findall(text)) for u in _UNIQUE]
    main = max(range(3), key=lambda i: (counts[i], -i)) if any(counts) else 0

    def word(m: re.Match) -> str:
        w = m[0]
        own = [i for i in range(3) if _UNIQUE[i].search(w)]
        to = own[0] if len(own) == 1 else main
        return w.translate(CYR_TO_LAT).translate(GRE_TO_LAT).translate(_BACK[to])

    return _WORD.sub(word, text)


def canonical(text: str | None) -> str | None:
    """The canonical form of one text."""
    if text is None:
        return None
    out = text
    if not out.isascii():
        out = _tables()[1].sub(lambda m: _run(m[0]), out)
        if _MIXED.search(out) and (_HAS_LATIN.search(out) or not _UNIQUE[1].search(out)):
            out = _scripts(out)
    return out.strip()


def is_stable(text):
    """Column: the quick check. A stable text is its own canonical form; others may or may not be."""
    cyr = text.rlike("[\u0370-\u052f]")
    return ~text.rlike(COARSE) & (~cyr | (text.rlike(CYR_UNIQUE) & ~text.rlike(f"[{_LATIN}\u0370-\u03ff]")))


def _with_canon(batches):
    for b in batches:
        at = b.schema.get_field_index("text")
        yield b.append_column("canon", pa.array([canonical(t) for t in b.column(at).to_pylist()], pa.string()))


def canonical_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``canon``, the canonical form of ``column``; only unstable rows go through Python."""
    df = df.withColumnRenamed(column, "text") if column != "text" else df
    known = df.where(F.col("text").isNull() | is_stable(F.col("text"))).withColumn("canon", F.col("text"))
    rest = df.where(~is_stable(F.col("text")))
    schema = df.withColumn("canon", F.lit("")).schema
    out = known.unionByName(rest.mapInArrow(_with_canon, schema))
    return out.withColumnRenamed("text", column) if column != "text" else out


def lookalike_pairs(df: DataFrame) -> DataFrame:
    """df: field, id, g1, g2, text. Pairs id_a < id_b of one (field, g1, g2) whose texts look alike but differ.

    Of two such texts at least one is unstable, so all rows meet the unstable ones only. Rows travel as hashes. Repeated
    rows count once; exact copies are no pair. All pairs of a class are returned, as the query's definition asks.
    """
    df = df.where(F.col("text").rlike("\\p{L}"))
    keys = ["field", "g1", "g2", "key"]

    def hashed(x: DataFrame, canon: str) -> DataFrame:
        return x.select("field", "id", "g1", "g2", F.xxhash64(canon).alias("key"), F.xxhash64("text").alias("raw"))

    stable = hashed(df.where(is_stable(F.col("text"))), "text")
    other = df.where(~is_stable(F.col("text")))
    other = cut(hashed(other.mapInArrow(_with_canon, other.withColumn("canon", F.lit("")).schema), "canon"))  # hashes, used twice
    right = other.select(*keys, F.col("id").alias("id2"), F.col("raw").alias("raw2"))
    met = stable.unionByName(other).join(right, keys).where((F.col("raw") != F.col("raw2")) & (F.col("id") != F.col("id2")))
    return met.select("field", F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b")).distinct()


def lookalike_classes(df: DataFrame) -> DataFrame:
    """df: field, id, g1, g2, text. One row a class of texts that look alike in a (field, g1, g2) and are not all the same: its
    first id, the number of texts and of different forms. Linear in the rows, where the pairs are quadratic in a class."""
    texts = canonical_texts(df.where(F.col("text").rlike("\\p{L}"))).select("field", "g1", "g2", "id", F.xxhash64("canon").alias("key"), F.xxhash64("text").alias("raw"))
    forms = texts.groupBy("field", "g1", "g2", "key", "raw").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("n"))
    out = forms.groupBy("field", "g1", "g2", "key").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("n_texts"), F.count("*").alias("n_forms"))
    return out.where("n_forms > 1").select("field", "class_id", "n_texts", "n_forms")

"""Problem 5: sentence units in 13 languages, by a maximum-entropy classifier of candidate boundaries.

Candidates are the places behind sentence marks with their closing quotes and brackets, line ends, and in Thai the blanks.
Each is described by the word before and the first word behind (how often they end and begin sentences, counted over all
sentences of the corpus), the mark, blanks, case, digits, script, quotes, a speech tag, and by what the word before is: an
abbreviation that binds to what follows or may also end a sentence, an initial, a list number, a part of a decimal. All of
them are features: logistic regression (maximum entropy) weighs them and alone decides.

Training. Reliable boundaries are the joints of neighbouring sentences of a book, on at most ``SAMPLE`` pairs, against all
candidates inside the sentences. As those show few abbreviations, the pairs are also trained with abbreviations, initials,
decimals, list numbers, trailing dots and bracketed remarks put inside, where no boundary is, and with abbreviations that end
a sentence put at its end, and with whole sentences in brackets or straight quotes.

A heading or subtitle is one unit. Offsets are half-open code points without outer white space. Defined results: null,
empty and blank texts, and texts without letter or digit, give no unit; very long texts are processed whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
#: Words counted in this many buckets; what begins or ends a sentence is kept apart in as many.
BUCKETS = 1 << 20

# --- fixed values: abbreviations that bind to what follows, and ones that may also end a sentence
BINDS = set(
    "dr mr mrs ms st prof rev hon capt col gen lt sgt vol vols p pp no nos fig figs cf eg ie viz approx ca ch sec ed eds vs "
    "hr fr bd s abb vgl nr z d h u a o bzw evtl sog str "
    "m mm mme mlle env av chap "
    "sr sra srta dra dr d dña pág págs aprox núm t art cap "
    "ул д кв корп г-н г-жа стр рис см т п с гл пр пер тов проф "
    "вул буд пров мал див проф р "
    "pvz t y vnt psl pav žr plg "
    "ดร กก รศ ผศ नं कि ग्रा डॉ श्री".split()
)
MAY_END = set("etc usw p.m a.m т.п т.д др г гг m d h kg km cm ฯลฯ u.s u.a jr sr co inc ltd і.т.п тощо ir.kt kt".split())
UNITS = {"m", "h", "d", "г"}
BIND_TWO = set("d.h z.b u.a i.e e.g p.ej p.ex т.е т.к o.ä u.ä i.d c.-à-d п.в कि.ग्रा".split())
# --- fixed values: verbs of speech tags in scripts without capitals
_TAG = re.compile(
    "^[^。！？…“”\\n]{0,24}?(?:说|问道|喊道|答道|叫道|道)(?=[。！？…])|^ ?(?:שאל|שאלה|אמר|אמרה|קרא|קראה|צעק|צעקה|השיב|לחש)(?![א-ת])|^ ?[^।!?…\\n“”]{0,60}(?:पूछा|कहा|चिल्लाया|चिल्लाई|बोला|बोली)(?=।)|^[฀-๿]{2,48}?(?:ถาม|พูด|ร้อง|ตะโกน|ตอบ)"
)
_MARKS = ".!?…。！？।｡‥"
_OPEN = "“„«‹「『（(【[¡¿‘\"'"
_CAND = re.compile(rf"[{_MARKS}]+[\"”»“’'」』)\]）】›]*|\n+|(?<=[฀-๿”…!]) +(?=[“฀-๿\d])")
_WORD = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")
_BARE = re.compile("[一-鿿㐀-䶿ぁ-ヿ]")
_THAI = re.compile("[฀-๿]")
_ALNUM = re.compile(r"[^\W_]")
#: A list number at the beginning of a unit, and two letters with a dot between.
_NUMBER = re.compile(r"[(\[]?(?:\d{1,4}|[ivxlcIVXLC]{1,5}|[a-zа-я])\.")
_PAIR = re.compile(r"[^\W\d_]\.[^\W\d_]")
#: A remark in brackets that is a sentence of its own.
_REMARK = re.compile(r"\([^\W\d_a-zа-я][^()]{2,80}[.!?…।]\)")


def before(text: str, at: int) -> str:
    """The token that ends at ``at``, in small letters: a word, or the last characters of a script without blanks."""
    left = text[max(0, at - 40) : at].rstrip(_MARKS + "\"”»“’'」』)]）】› \n\xa0")
    if not left:
        return ""
    if _BARE.match(left[-1]):
        return left[-2:]
    if _THAI.match(left[-1]):
        return left[-4:]
    m = list(_DOTTED.finditer(left))
    return m[-1][0].lower() if m and m[-1].end() == len(left) else left[-1]


_DOTTED = re.compile(r"[^\s\"”»“„«‘’'()\[\]（）,;:—–-]+(?:[’'-][^\W\d_]+)*")


def behind(text: str, at: int) -> str:
    """The token that begins at ``at``, opening marks skipped."""
    right = text[at : at + 40].lstrip(_OPEN + " \n\xa0　")
    if not right:
        return ""
    if _BARE.match(right[0]):
        return right[:2]
    if _THAI.match(right[0]):
        return right[:4]
    m = _WORD.match(right)
    return m[0] if m else right[0]


def tokens(text: str) -> list[str]:
    out = [w.lower() for w in _DOTTED.findall(text)]
    bare = [text[i : i + 2] for i in range(len(text) - 1) if _BARE.match(text[i])] if _BARE.search(text) else []
    thai = [text[i : i + 4] for i in range(len(text) - 3) if _THAI.match(text[i])] if _THAI.search(text) else []
    return out + bare + thai


def _bucket(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) & (BUCKETS - 1)


def _count(batches):
    """Counts by kind (0 begins, 1 ends a sentence, 2 tokens but the last mark's, 3 words and bare pairs) and word bucket."""
    seen: Counter[tuple[int, str]] = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            if t and (t := t.strip()):
                seen[0, behind(t, 0)] += 1
                seen[1, before(t, len(t))] += 1
                bare = tokens(t.rstrip(_MARKS + "\"”»“’'」』)]）】›"))
                seen.update((2, w) for w in bare)
                seen.update((3, w) for w in _WORD.findall(t))
                seen.update((3, w) for w in bare if _BARE.match(w) or _THAI.match(w))
        if len(seen) > 1_000_000:
            yield _sums(seen)
            seen = Counter()
    if seen:
        yield _sums(seen)


def _sums(seen: Counter) -> pa.RecordBatch:
    out: dict[int, int] = {}
    for (kind, w), n in seen.items():
        k = kind * BUCKETS + _bucket(w)
        out[k] = out.get(k, 0) + n
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.int64())], ["k", "n"])


class Model:
    """The counts, 4 x BUCKETS, and the classifier's weights."""

    def __init__(self, counts: np.ndarray, weights=None):
        self.counts, self.weights, self.known = counts, weights, {}

    def __reduce__(self):
        return Model, (self.counts, self.weights)

    def share(self, word: str, part: int, whole: int) -> float | None:
        """log of how often the word is a sentence's beginning (0 of 3) or end (1 of 2); None for a word never seen."""
        key = (word, part)
        if key not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            k = _bucket(word)
            n, all_ = int(self.counts[part, k]), int(max(self.counts[whole, k], self.counts[part, k]))
            self.known[key] = float(np.log((n + 0.05) / (all_ + 2.0))) if all_ else None
        return self.known[key]

    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        """Place of the cut, end of the unit before it, and the mark."""
        out = []
        german = "„" in text
        for m in _CAND.finditer(text):
            mark, end = m[0], m.end()
            if mark[0] in _MARKS:
                if "“" in mark and not german:  # an opening quote glued to the mark
                    end = m.start() + mark.index("“")
                core = mark.rstrip("\"”»“’'」』)]）】›")
                if end < m.end() or end < len(text):
                    out.append((end, end, mark[: len(core) + (end - m.start() - len(core) if end - m.start() > len(core) else 0)]))
            elif mark[0] == "\n":
                out.append((m.start(), m.start(), "\n"))
            else:
                out.append((m.start(), m.start(), " "))
        return [c for c in out if 0 < c[0] < len(text)]

    def features(self, text: str, begun: int, at: int, mark: str, unseen: tuple[float | None, bool] = (None, False)) -> np.ndarray:
        """Of the candidate at ``at`` in a unit that began at ``begun``. unseen: in training, takes the words for unknown ones."""
        left, rest = before(text, at), text[at : at + 90]
        bare = rest.lstrip()
        right = behind(text, at)
        nxt, inner = bare[:1], bare.lstrip(_OPEN + " \xa0\u202f")[:1]
        closed = mark[-1:] in "\"”»“’'」』)]）】›"
        first = mark[0]
        e, s = self.end_start(left, right, first, unseen)
        upper, lower, digit = inner.isupper(), inner.islower(), inner.isdigit()
        caseless = bool(inner) and inner.isalpha() and not (upper or lower)
        dots = first == "…" or mark.startswith("..")
        glued = bool(rest) and len(bare) == len(rest)
        number = binds = ends = two = initial = pair = False
        if first == "." and len(mark) == 1:
            number = bool(_NUMBER.fullmatch(text[begun:at].strip())) or rest[:1].isdigit() and text[at - 2 : at - 1].isdigit()
            raw = _DOTTED.findall(text[max(0, at - 24) : at - 1])
            word = raw[-1].lstrip(_MARKS) if raw and text[at - 2 : at - 1] not in " \xa0" else ""
            low = word.lower().strip(".")
            both = (raw[-2].lower().strip(".") + "." + low) if len(raw) > 1 else ""
            two = both in BIND_TWO
            ends = low in MAY_END or both in MAY_END or word.lower() in MAY_END
            binds = low in BINDS and both not in ("т.п", "т.д", "и.др")
            if binds and ends:  # a title in capitals, a unit in small letters
                binds = word[:1].isupper() or low not in UNITS
                ends = not binds
            initial = len(word) == 1 and word.isalpha() and word.isupper()
            pair = bool(_PAIR.fullmatch(word))
        tag = closed and first in _MARKS and bool(_TAG.match(rest))
        remark = mark[-1] in ")）" and text[begun:at].lstrip()[:1] in "(（"
        inside = mark[-1] in ")）" and not remark
        plain = first == "." and len(mark) == 1 and len(left) > 2 and not (number or binds or ends or two or initial or pair)
        line, blank = first == "\n", first == " "
        return np.array([
            1, e, s, first == "." and not dots, first in "!?！？", dots, first in "。｡।", line, blank, upper, lower and not line, digit, bool(nxt) and nxt in _OPEN, caseless,
            glued, closed, tag, bool(nxt) and nxt in ",;:、，；—–" and not line, bool(nxt) and nxt in "-と)", len(left) == 1 and not (ends or binds or two), dots * s, dots * caseless, dots * caseless * s, blank * s, blank * e, closed * s, caseless * s,
            number, binds, ends * (not upper), ends * upper, two, initial, pair * (not upper), glued * (lower or digit), binds * upper, binds * digit, inside, remark, remark * s, bool(_REMARK.match(bare)), blank * digit, digit * first in ".…", lower * closed, closed * upper, closed * caseless, closed * (first == "."), plain * upper, plain * caseless, blank * (right in MAY_END or right[:3] in MAY_END), blank * (left in MAY_END or left[-3:] in MAY_END), not bare,
        ], float)

    def end_start(self, left: str, right: str, first: str, unseen: tuple[float | None, bool] = (None, False)) -> tuple[float, float]:
        """How often the token before ends and the one behind begins a sentence; for unseen tokens by their form."""
        e = self.share(left, 1, 2)
        e = -3.2 if e is None else e
        e = e if unseen[0] is None else unseen[0]
        s = 0.0 if not right else None if unseen[1] else self.share(right, 0, 3)
        if s is None:
            s = -1.0 if right[0].isupper() else -1.5 if right[0].isdigit() else -6.0 if right[0].islower() else -3.5
        return (max(e, -2.0) if first in "。！？।!?" else e), s

    def units(self, text: str | None, role: str | None = "body") -> list[tuple[int, int]]:
        if not text or not _ALNUM.search(text):
            return []
        if role in ("heading", "subtitle"):
            return [self._strip(text, 0, len(text))]
        cuts, begun = [], 0
        for at, end, mark in self.candidates(text):
            if self.features(text, begun, at, mark) @ self.weights > 0:
                cuts.append(end)
                begun = at
        out = []
        for s, e in zip([0, *cuts], [*cuts, len(text)]):
            s, e = self._strip(text, s, e)
            if s < e and _ALNUM.search(text, s, e):
                out.append((s, e))
            elif s < e and out:  # marks alone belong to the unit before
                out[-1] = (out[-1][0], e)
        return out

    @staticmethod
    def _strip(text: str, s: int, e: int) -> tuple[int, int]:
        part = text[s:e]
        return s + len(part) - len(part.lstrip()), e - len(part) + len(part.rstrip())


def fit(sentences: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts over all sentences, in one scan and a fixed size, and the classifier on a bounded sample of joints."""
    got = sentences.select("src").mapInArrow(_count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(4 * BUCKETS)
    for b in got.toArrow().to_batches():
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    model = Model(counts.astype(np.float32).reshape(4, BUCKETS))
    step = max(1, -(-sentences.count() // sample))
    near = F.pmod(F.xxhash64("book_id", F.floor(F.col("sentence_id") / 2)), F.lit(step)) == 0
    rows = sentences.where(near).where("length(trim(src)) > 0").select("book_id", "sentence_id", "src").dropDuplicates(["sentence_id"]).orderBy(F.xxhash64("book_id", F.floor(F.col("sentence_id") / 2)), "sentence_id").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r.book_id, r.sentence_id))
    return train(model, [(a.src.strip(), b.src.strip()) for a, b in zip(rows, rows[1:]) if a.book_id == b.book_id])


_LATIN_BINDS, _CYRILLIC_BINDS = sorted(w for w in BINDS if w.isascii()), sorted(w for w in BINDS if "а" <= w[0] <= "я" and len(w) > 1)
_LATIN_ENDS, _CYRILLIC_ENDS = sorted(w for w in MAY_END if w.isascii()), sorted(w for w in MAY_END if "а" <= w[0] <= "я")

_LATIN_TWO, _CYRILLIC_TWO = sorted(w for w in BIND_TWO if w[0] < "\u0250"), sorted(w for w in BIND_TWO if "а" <= w[0] <= "я")


def _with_insides(text: str, rng) -> tuple[str, str]:
    """The sentence with something inside it that looks like a boundary and is none; and what was put in. Unchanged, "" where
    nothing suits."""
    words = text.split(" ")
    if len(words) < 4 or _BARE.search(text) or _THAI.search(text):
        if len(text) > 8 and (_BARE.search(text) and not _ALNUM.search(text[-1:]) or _THAI.search(text)):
            k = int(rng.integers(2, len(text) - 3))
            if text[k - 1].isalpha() and text[k].isalpha():
                thai = [" ", f" {text[:5].strip()} ฯลฯ ", f" {text[:5].strip()} {text[2:8].strip()} "] if _THAI.search(text) else []
                put = str(rng.choice(["……", "…", "（？）", "（！）", "3.5", *thai]))
                return text[:k] + put + text[k:], put
        return text, ""
    cyrillic = bool(re.search("[а-яё]", text))
    k = int(rng.integers(1, len(words) - 1))
    kind = rng.integers(9)
    name = words[k][:1].upper() + words[k][1:]
    if kind < 3:
        word = str(rng.choice(_CYRILLIC_BINDS if cyrillic else _LATIN_BINDS))
        put = [(word.capitalize() if rng.random() < 0.5 else word) + ".", name if rng.random() < 0.6 else words[k] if rng.random() < 0.6 else str(rng.integers(1, 99)) + " " + words[k]]
    elif kind == 3:
        put = [str(rng.choice(list("АВКМНС" if cyrillic else "ABEJKLMT"))) + ".", name]
    elif kind == 4:
        put = [f"{rng.integers(1, 40)}.{rng.integers(1, 99)}", words[k]]
    elif kind == 5:
        put = [str(rng.choice(_CYRILLIC_ENDS if cyrillic else _LATIN_ENDS)) + ".", words[k][:1].lower() + words[k][1:]]
    elif kind == 6:
        return " ".join([*words[:k], words[k] + str(rng.choice(["…", "...", "!", "?"])) if rng.random() < 0.7 else words[k] + " …", words[k + 1][:1].lower() + words[k + 1][1:], *words[k + 2 :]]), "…"
    elif kind == 7:
        put = [f"({words[k]}{rng.choice(['!', '?', '.'])})", words[k][:1].lower() + words[k][1:]]
    else:
        one, _, other = str(rng.choice(_CYRILLIC_TWO if cyrillic else _LATIN_TWO)).partition(".")
        put = [f"{one}.{rng.choice([' ', '', chr(0xA0)])}{other}.", name if rng.random() < 0.5 else words[k]]
    return " ".join([*words[:k], *put, *words[k + 1 :]]), put[0]


def examples(a: str, b: str, rng) -> list[tuple[str, int, int]]:
    """Texts of two sentences with the range of the joint between them: plain, with insides, with an abbreviation at the end, with a
    list number."""
    thai = bool(_THAI.search(a[-3:]))
    joint = " " if thai else str(rng.choice([" ", " ", " ", " ", " ", " ", "  ", "\xa0", "", "\n"])) if not _BARE.search(a) else str(rng.choice(["", "", "", " ", "　"]))
    out = [(a, joint, b)]
    if rng.random() < 0.5:
        out.append((_with_insides(a, rng)[0], joint or " ", _with_insides(b, rng)[0]))
    if rng.random() < 0.1 and not (thai or _BARE.search(a)) and a[-1:] == "." and b[:1].isupper():
        word = str(rng.choice(_CYRILLIC_ENDS if re.search("[а-яё]", a) else _LATIN_ENDS)).replace(".", str(rng.choice([".", ". "])))
        out.append((f"{a[:-1]} {word}.", " ", b))
    if rng.random() < 0.12:
        o, c = ("（", "）") if _BARE.search(a) else ("(", ")")
        out.append((f"{o}{a}{c}", joint or ("" if o == "（" else " "), b) if rng.random() < 0.5 else (a, joint or ("" if o == "（" else " "), f"{o}{b}{c}"))
    if rng.random() < 0.06 and not thai and not _BARE.search(a):
        q = str(rng.choice(["'", '"']))
        out.append((f"{q}{a}{q}", " ", b))
    if rng.random() < 0.08 and not thai:
        n = rng.integers(1, 30)
        out.append((a, joint or " ", f"{rng.choice([f'{n}.', f'{n})', f'({n})', 'IV.', 'b.'])} {b}"))
    return [(x + j + y, len(x), len(x) + len(j)) for x, j, y in out]


def train(model: Model, pairs: list[tuple[str, str]]) -> Model:
    rng = np.random.default_rng(0)
    x, y = [], []
    for a, b in pairs:
        for both, lo, hi in examples(a, b, rng):
            begun = 0
            for at, _, mark in model.candidates(both):
                # words that the counts don't know, or not at this place, come too
                blind = (rng.normal(-3.5, 0.8) if rng.random() < 0.3 else None, rng.random() < 0.3) if mark != " " else (None, False)
                x.append(model.features(both, begun, at, mark, blind))
                y.append(float(lo <= at <= hi))
                begun = at if y[-1] else begun
    x, y = np.array(x), np.array(y)
    size = len(model.features("a. b", 0, 2, "."))
    w = np.zeros(size)
    w[0] = 1.0  # without training data every candidate is a boundary
    for _ in range(40 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(size) * 0.2
        w += np.linalg.solve(h, x.T @ (y - p) - 0.2 * w)
    model.weights = w
    return model


def sentence_units(paragraphs: DataFrame, model: Model) -> DataFrame:
    """paragraphs: para_id, role, text. One row a unit: para_id, sent_idx, s, e, src, words (offsets of its words in src)."""
    ship = paragraphs.sparkSession.sparkContext.broadcast(model)
    word = re.compile(r"[^\W\d_]+(?:[ְ-ׇऀ-ः़-ॏัิ-ฺ็-๎̀-ͯ]*[^\W\d_]*)*(?:['’-][^\W\d_]+)*")

    def run(batches):
        m = ship.value
        for b in batches:
            rows = []
            for d, role, t in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("para_id", "role", "text"))):
                for i, (s, e) in enumerate(m.units(t, role)):
                    rows.append((d, i, s, e, t[s:e], [{"s": w.start(), "e": w.end()} for w in word.finditer(t[s:e])]))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["para_id", "sent_idx", "s", "e", "src", "words"])

    return paragraphs.select("para_id", "role", "text").mapInArrow(run, "para_id long, sent_idx int, s long, e long, src string, words array<struct<s:int,e:int>>")

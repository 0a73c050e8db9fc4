"""Problem 4: text decoded with the wrong character encoding.

Score. Over all values, adjacent character pairs are counted; a pair's score is its squared mutual information
log(n12^2 / (n1 n2)), which is high for pairs that stand together and low for chance neighbours, whatever the size of the
corpus. Values that a strict inverse of a UTF-8 misreading restores, and ones with marks of lost bytes, are left out of the
counts, as they would make their own damage look usual.
Isolate. Maximum-scoring segments of (LIMIT - score) are the improbable runs of a value; values without such a run are
sound and are settled in bulk.
Test. Only inside those runs, widened to whole words, inverse mappings are tried: encode as what the text was read as,
decode as what it was. All candidates of a run are scored in one array; one is accepted if it raises the score of the run
enough. Once a mapping holds, weaker runs of the same value are tried with it too. Rounds go on as long as a mapping is
accepted, so text misread several times and any number of runs come out. What an encoder replaced (U+FFFD, question marks
in place of letters or quotes) is damage that cannot be undone; it counts where it lies inside an improbable run.

Bounds: pairs are counted in 2**22 hash buckets, characters by code point, so the model has a fixed size.
Defined results: null and empty values are sound; a value that only partly can be restored is returned with that part
restored and ``recovered`` false; rare but correct characters alone are never damage, nor are repeated or mixed marks at the
end of a sentence (``?!``, ``??``, ``…?``); typographic marks, blanks and invisible characters alone are never mapped to
letters; look-alike letters of another script stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.normalize import _HAS_LATIN, _MIXED, _scripts

BUCKETS = 1 << 22
#: A pair below this score is improbable; a segment above SEGMENT is a run to look into.
LIMIT, SEGMENT = -9.0, 1.5
#: The score a restored run must gain in all, and per character.
GAIN, GAIN_EACH = 9.0, 0.9
#: So many signs inside words that no text holds make an improbable run damaged even if no mapping explains it.
STRANGE = 3

#: What text was read as, and what it was. The Windows and DOS readings keep undefined bytes as control characters.
READ_AS = ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "gbk", "shift_jis", "latin_1", "cp1250", "cp1255", "cp874", "big5")
REALLY = ("utf_8", "cp1252", "cp1251", "koi8_r", "koi8_u", "cp866", "gbk", "shift_jis", "euc_jp", "big5", "cp1255", "cp874", "cp1257", "cp850", "cp437", "mac_roman", "mac_cyrillic", "iso8859_5", "cp862", "cp775")
WIDE = {"gbk", "shift_jis", "big5", "euc_jp"}

_CONTROL = re.compile("[\x80-\x9f]")
#: Question marks that stand for lost bytes: inside and before words, behind commas, in rows that no word leads; and, where a
#: quotation is opened and not closed, behind the mark that ends it.
_LOST = re.compile("\ufffd|(?<=[^\\W\\d_])\\?(?=[^\\W\\d_])|(?:^|(?<=[\\s(\\[«“„\"'—–]))\\?+(?=[^\\W\\d_])|(?<=[,;:])\\?|(?<=[(\\[])\\?(?=\\d)|(?:^|(?<=[\\s(\\[]))\\?{2,}|(?<![^\\W\\d_?!…])\\?{3,}")
_CLOSING = re.compile("(?<=[.!?…])\\?")


def lost_marks(text: str) -> list[tuple[int, int]]:
    """Where bytes were lost."""
    if "?" not in text and "\ufffd" not in text:
        return []
    out = [m.span() for m in _LOST.finditer(text)]
    if text.count("“") > text.count("”") and "„" not in text or text.count("«") > text.count("»") or text.startswith("?"):
        out += [m.span() for m in _CLOSING.finditer(text)]
    return out



@lru_cache(64)
def _bytes_of(encoding: str) -> dict[int, bytes]:
    """Character to byte for a single-byte reading; undefined bytes are the control characters of their number."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = bytes([b])
    return out


def _encode(text: str, encoding: str) -> bytes | None:
    """The bytes the text was read from; None where it cannot have been read so."""
    if encoding in WIDE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _bytes_of(encoding)
    try:
        return b"".join([table[ord(c)] for c in text])
    except KeyError:
        return None


_LEADS = {"cp1252": "ãâåäðñ×àáéêëìíîï", "cp437": "γ├┬"}
_FOREIGN = re.compile("[\u0700-\u08ff\u1000-\u1dbf\u3400-\u4dbf\ua000-\uabff]")
_SEQUENCE = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


@lru_cache(64)
def _as_bytes(encoding: str, lower: bool) -> dict[int, str]:
    """Each character as the byte it was read from; what the encoding doesn't hold becomes a character that is no byte. lower:
    the text lost its capitals since."""
    table = _bytes_of(encoding)
    out = {c: "\uf8ff" for c in range(0x80, 0x100)} | {c: b.decode("latin_1") for c, b in table.items()}
    if lower:
        for c in [*map(ord, _LEADS.get(encoding, "")), *(table if encoding == "cp437" else ())]:
            up = chr(c).upper()
            if len(up) == 1 and ord(up) in table:
                out[c] = table[ord(up)].decode("latin_1")
    return out


def _undo_utf8(text: str, encoding: str) -> tuple[str, int]:
    """Replaces every well-formed UTF-8 sequence that was read as ``encoding``; the number of sequences. Lost bytes and all
    other characters stay. A lead byte whose letter became lower case is taken as its capital."""
    if encoding in WIDE:
        try:
            raw = text.encode(encoding, "replace").replace(b"?", b"\xff") if "\ufffd" in text else text.encode(encoding)
        except UnicodeEncodeError:
            return text, 0
        out = raw.decode("utf-8", "replace")
        bad = out.count("\ufffd")
        good = sum(ord(c) > 127 for c in out) - bad
        return (out, good) if good >= 2 and bad <= max(2, good // 3) else (text, 0)
    for lower in (False, True) if encoding in _LEADS else (False,):
        out, last, n = [], 0, 0
        for m in _SEQUENCE.finditer(text.translate(_as_bytes(encoding, lower))):
            try:
                c = m[0].encode("latin_1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            # a control character may be a byte misread before; scripts that none of the languages has are chance
            if "\x80" <= c <= "\x9f" or unicodedata.category(c) not in ("Cn", "Co", "Cc") and not _FOREIGN.match(c):
                out += [text[last : m.start()], c]
                last, n = m.end(), n + 1
        if n:
            return "".join(out) + text[last:], n
    return text, 0


#: Beginnings of misread UTF-8, which stay when a byte was lost.
_TYPICAL = re.compile("â€|Ã[\x80-¿ƒ‚„†‡‰Š‹Œ‘-™š›œ]|Â[\x80-¿]|[ÐÑ×][\x80-¿‘-™€]|ΓÇ|‚Ä|Ã¢|вЂ")


def strictly_restored(text: str) -> bool:
    """Whether a whole-text inverse of a UTF-8 misreading works, or its typical beginnings are there: the values left out of the counts."""
    if _TYPICAL.search(text):
        return True
    for e in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gbk", "shift_jis"):
        if (e in WIDE) != bool(re.search("[一-鿿ｦ-ﾟ]", text)):
            continue
        out, n = _undo_utf8(text, e)
        if n >= 3 or n and (len(text) - len(out) + n) * 2 >= sum(ord(c) > 127 for c in text):
            return True
    return False


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each preceded by a line feed, and where each begins."""
    joined = "\n" + "\n".join(texts) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return cps, np.concatenate([[0], ends])


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)).astype(np.int64)


_SAFE = re.compile("^[\x00-\x7f‘-„–—…«»¡¿А-Яа-яёЁіїєґІЇЄҐא-תऀ-ॿ฀-๿ぁ-ヿ、。「」！？，·°№]*$")


def _count(batches):
    """Pair (kind 1) and character (kind 0) counts of the values that no strict inverse restores."""
    keys, counts, pending = [], [], 0

    def merged():
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return [k], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]

    for b in batches:
        texts = [t for t in b.column(b.schema.get_field_index("value")).to_pylist() if t]
        texts = [t for t in texts if not ("?" in t and lost_marks(t)) and (_SAFE.match(t) or not ("\ufffd" in t or _CONTROL.search(t) or strictly_restored(t)))]
        if not texts:
            continue
        cps, _ = code_points(texts)
        for k in (cps.astype(np.int64), _hash(cps[:-1], cps[1:]) + (1 << 32)):
            u, n = np.unique(k, return_counts=True)
            keys.append(u), counts.append(n)
        pending += len(texts)
        if len(keys) > 64:
            keys, counts = merged()
    if keys:
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["k", "n"])


class PairModel:
    """Squared mutual information of character pairs."""

    def __init__(self, ones: np.ndarray, pairs: np.ndarray):
        self.tried: dict = {}  # words recur
        self.seen = ones > 0
        ones = ones + 1.0
        most = ones.max()
        ones[0x80:0xA0], ones[0xFFFD], ones[0xE000:0xF900] = most, most, most  # what no text holds: any pair with it is improbable
        self.ones, self.pairs = np.log(ones).astype(np.float32), np.log(pairs + 0.1).astype(np.float32)

    def score(self, cps: np.ndarray) -> np.ndarray:
        a, b = cps[:-1], cps[1:]
        return 2 * self.pairs[_hash(a, b)] - self.ones[np.minimum(a, 0x10FFFF)] - self.ones[np.minimum(b, 0x10FFFF)]

    def text_scores(self, text: str) -> np.ndarray:
        return np.clip(self.score(np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)), -16, 0)


def fit(values: DataFrame) -> PairModel:
    """Counts over all values (column value); the result has a fixed size."""
    got = values.select("value").mapInArrow(_count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    ones, pairs = np.zeros(0x110000), np.zeros(BUCKETS)
    for b in got.toArrow().to_batches():
        k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        pair = k >= 1 << 32
        pairs[k[pair] - (1 << 32)] += n[pair]
        ones[k[~pair]] += n[~pair]
    return PairModel(ones, pairs)


def segments(score: np.ndarray, limit: float = LIMIT, least: float = SEGMENT) -> list[tuple[int, int]]:
    """Maximum-scoring segments of (limit - score), as character ranges of the text whose pairs, with both ends, these are."""
    out, run, start, best, end = [], 0.0, 0, 0.0, 0
    for i, x in enumerate((limit - score).tolist()):
        if run <= 0:
            if best >= least:
                out.append((start, end))
            run, start, best = 0.0, i, 0.0
        run += x
        if run > best:
            best, end = run, i + 1
    if best >= least:
        out.append((start, end))
    return [(max(0, a - 1), b) for a, b in out]


_WORDISH = re.compile(r"\S+")


def _widen(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs widened to whole words; runs of neighbouring words joined."""
    words = [m.span() for m in _WORDISH.finditer(text)]
    hit = [any(a < e and s < b for a, b in runs) for s, e in words]
    out: list[list[int]] = []
    for k, (s, e) in enumerate(words):
        if hit[k]:
            if out and out[-1][2] == k - 1:
                out[-1][1:] = [e, k]
            else:
                out.append([s, e, k])
    return [(s, e) for s, e, _ in out]


#: Marks, blanks and invisible characters that texts of any language hold by themselves.
_MARKS = frozenset("…–—‘’‚“”„«»‹›·•°№½¼¾×±§©®™¡¿ªº\xa0\xad\u200b\u200c\u200d\u200e\u200f\ufeff")


@lru_cache(512)
def _turned(read: str, real: str) -> dict[int, str]:
    """Character to character for text of one single-byte encoding that was read as another; what cannot be becomes a null."""
    out = {}
    for c, b in _bytes_of(read).items():
        if c >= 0x80:
            try:
                out[c] = b.decode(real)
            except UnicodeDecodeError:
                out[c] = "\0"
    return out


@lru_cache(64)
def _sequence_bytes(read: str) -> tuple[frozenset, frozenset]:
    """The characters that may be the first byte of a UTF-8 sequence read so, and the ones that may be a later one."""
    t = _as_bytes(read, False).items(), _as_bytes(read, True).items()
    at = lambda lo, hi: frozenset(chr(c) for x in t for c, b in x if lo <= b <= hi)
    return at("\xc2", "\xf4"), at("\x80", "\xbf")


@lru_cache(65536)
def _script(c: str) -> str:
    """The script of a letter, empty for what is none."""
    return unicodedata.name(c, "?").split(" ")[0] if c.isalpha() else ""


_UNSEEN = {ord(c): None for c in "\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"}
_READABLE = {e: frozenset(map(chr, _bytes_of(e))) for e in READ_AS if e not in WIDE}


def _candidates(run: str, sequences_only: bool):
    """(text, sequences, reading, real encoding) of every inverse mapping that may apply to the run; sequences_only: no others than
    those of UTF-8."""
    wide = any("\u2e80" <= c <= "\u9fff" or "\uff61" <= c <= "\uff9f" for c in run)
    plain = run.replace("\xa0", " ")  # a no-break space is no letter of another encoding
    special = {c for c in plain if c > "\x7f"}
    letters = sum(map(str.isalpha, special))
    alone = special <= _MARKS and len(special) <= 2 and not _ODD.search(run.translate(_UNSEEN))
    for read in READ_AS:
        if (read in WIDE) > wide:
            continue
        if read in WIDE or not special.isdisjoint(_sequence_bytes(read)[0]) and not special.isdisjoint(_sequence_bytes(read)[1]):
            fixed, n = _undo_utf8(run, read)
            while n:  # text may have been misread several times over
                yield fixed, n, read, "utf_8"
                fixed, n = _undo_utf8(fixed, read)
        if sequences_only or alone:
            continue
        if read in WIDE:
            raw = _encode(plain, read)
        elif special and special <= _READABLE[read]:
            for real in REALLY[1:]:
                if real in WIDE or real == read:
                    continue
                turned = _turned(read, real)
                to = [turned[ord(c)] for c in special]
                # letters come out of one script, and letters or usual marks out of letters
                if "\0" not in to and len({x for c in to if (x := _script(c))}) <= 1 and sum(c.isalpha() or c in _MARKS for c in to) * 2 >= letters:
                    yield plain.translate(turned), 0, read, real
            raw = _encode(plain, read) if len(run) >= 4 and len(special) >= 2 else None
        else:
            continue
        if raw is None:
            continue
        for real in REALLY[1:]:
            if real == read or read not in WIDE and real not in WIDE or real in WIDE and len(run) < 4:
                continue
            try:
                yield raw.decode(real), 0, read, real
            except UnicodeDecodeError:
                pass


#: What no text of the supported languages holds inside words: drawn boxes, half-width kana, symbols among letters, capitals after small letters.
_ODD = re.compile(
    "[\u2500-\u259f\uff61-\uff9f\ufffd]|(?<=[^\\W\\d_])[¡-©«-¹»-¿×÷ƒ„†‡ˆ‰‹•˜™›¤€]|[¢-¦¨©¬®-²¹¼-¿×÷ƒ†‡ˆ‰˜™¤](?=[^\\W\\d_])"
    "|(?<=[a-zß-öø-ÿа-џāčēėęģīįķļņšūųž])[A-ZÀ-ÖØ-ÞА-ЯЁĀČĒĢĪĶĻŃŅŌŠŪŽ]"
)


def _one_script(text: str) -> bool:
    kinds = {unicodedata.name(c, "?").split(" ")[0] for c in text if c.isalpha()}
    return len(kinds - {"HIRAGANA", "KATAKANA", "CJK"}) + bool(kinds & {"HIRAGANA", "KATAKANA", "CJK"}) == 1


_NO_TEXT = re.compile("[\0-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ue000-\uf8ff]")


def _shadow(text: str) -> str:
    """For scoring, look-alike letters count as the ones they look like: they are another matter."""
    return _scripts(text) if _MIXED.search(text) and _HAS_LATIN.search(text) else text


def _best(out: str, shadow: str, s: int, e: int, score: np.ndarray, model: PairModel, known: frozenset | None = None):
    """The inverse mapping that raises the run out[s:e] most: (text, mapping), or None. known: only these mappings, which have
    proved themselves in the same value and need not gain as much."""
    run = out[s:e]
    before, behind = out[s - 1 : s] or "\n", out[e : e + 1] or "\n"
    plain = run.replace("\xa0", " ")
    odd, alphas = len(_ODD.findall(run)), sum(map(str.isalpha, run))
    kept = []
    alike = known is None and shadow[s:e] != run and _one_script(shadow[s:e])  # look-alike letters alone make it odd
    for fixed, sequences, read, real in _candidates(run, alike):
        if known is not None and (read, real) not in known or fixed in (run, plain) or _NO_TEXT.search(fixed):
            continue
        now = len(_ODD.findall(fixed))
        if now > odd or now and not sequences or not sequences and sum(map(str.isalpha, fixed)) < 0.7 * min(len(fixed), alphas):
            continue
        kept.append((fixed, sequences, now, (read, real)))
    if not kept:
        return None
    # all candidates in one array, each with its neighbours and a line feed between
    cps, at = code_points([before + f + behind for f in [plain, *(k[0] for k in kept)]])
    all_ = np.clip(model.score(cps), -16, 0)
    strange = ~model.seen[np.minimum(cps, 0x10FFFF)]
    strange[: at[1] + 1] = False  # of the candidates, not of the run itself
    all_[strange[1:] | strange[:-1]] = -16  # nothing is restored to characters that no value holds
    of = lambda i: all_[at[i] + 1 : at[i + 1] - 1]
    old, old_plain, width = float(score[s : e + 1].sum()), float(of(0).sum()), e - s + 1
    best, gain = None, 0.0
    for i, (fixed, sequences, now, how) in enumerate(kept, 1):
        new = of(i)
        # one score a character, so that a shorter text gains nothing by being short
        was = old if sequences else old_plain
        g = float((new - LIMIT).sum()) - (was - LIMIT * width) + 3 * sequences
        sure = g >= (GAIN / 2 if sequences or odd > now else GAIN) and new.mean() - was / width >= GAIN_EACH
        if g > gain and (sure or known is not None or odd >= 2 and not now and _one_script(fixed)):
            best, gain = (fixed, how), g
    return best


def examine(text: str, model: PairModel) -> tuple[bool, str]:
    """Whether the value is damaged, and the value as far as it can be restored."""
    damaged, out = False, text
    known: frozenset = frozenset()
    first = None
    while True:
        shadow = _shadow(out)
        score = model.text_scores(shadow)
        found = segments(score)
        first = found if first is None else first
        strong = _widen(out, found)
        spans = [(strong[0][0], strong[-1][1])] if len(strong) > 1 else []
        changed = False
        # what holds elsewhere in the value is tried before all else; then the runs as one, then each by itself
        for part, only in ([(strong, known)] if known else []) + [(spans, None), (strong, None)] + ([(_widen(out, segments(score, least=0.01)), known)] if known else []):
            for s, e in reversed(part):
                if out[s:e].isascii():
                    continue
                key = (out[s - 1 : s], out[s:e], out[e : e + 1], shadow[max(0, s - 1) : e + 1], only)  # all that the result depends on
                if key not in model.tried:
                    if len(model.tried) > 50_000:
                        model.tried.clear()
                    model.tried[key] = _best(out, shadow, s, e, score, model, only)
                if b := model.tried[key]:
                    out, known, changed = out[:s] + b[0] + out[e:], known | {b[1]}, True
            if changed:
                break
        damaged |= changed
        if not changed:
            break
    marks = lost_marks(text) + [m.span() for m in _CONTROL.finditer(text)]
    if not damaged:
        damaged = any(a <= e and s <= b for a, b in first for s, e in marks) or any(len(_ODD.findall(text[s:e].translate(_UNSEEN))) >= STRANGE for s, e in _widen(text, first))
    return damaged, out if damaged else text


def _examiner(model, keep: list[str]):
    def run(batches):
        m, seen = model.value, {}
        for b in batches:
            values = [t or "" for t in b.column(b.schema.get_field_index("value")).to_pylist()]
            cps, at = code_points(values)
            s = LIMIT - np.clip(m.score(cps), -16, 0)  # one score a pair; the pair before a line feed is its text's last
            total = np.cumsum(s) - np.repeat(np.arange(len(values)), np.diff(at)) * 1e6
            before = np.concatenate([[0.0], total[:-1]])
            before[at[1:-1]] = total[at[1:-1]] - s[at[1:-1]]
            peak = np.maximum.reduceat(total - np.minimum.accumulate(before), at[:-1])
            rows, fixed, recovered = [], [], []
            for i in range(len(values)):
                t = values[i]
                if t and peak[i] >= SEGMENT and (not t.isascii() or lost_marks(t)):  # nothing else in ASCII can be damage
                    if t not in seen:  # the same texts recur
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[t] = examine(t, m)
                    damaged, out = seen[t]
                    if damaged:
                        rows.append(i), fixed.append(out), recovered.append(not (lost_marks(out) or _CONTROL.search(out)))
            kept = b.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(c)) for c in keep), kept.column(kept.schema.get_field_index("value")), pa.array(fixed, pa.string()), pa.array(recovered, pa.bool_())], [*keep, "value", "restored", "recovered"])

    return run


def damaged_values(values: DataFrame, model: PairModel | None = None) -> DataFrame:
    """values: any keys and ``value``. The damaged ones, with the value restored as far as possible."""
    model = model or fit(values)
    keep = [c for c in values.columns if c != "value"]
    ship = values.sparkSession.sparkContext.broadcast(model)
    schema = values.select(*keep, "value", F.lit("").alias("restored"), F.lit(True).alias("recovered")).schema
    return values.mapInArrow(_examiner(ship, keep), schema)

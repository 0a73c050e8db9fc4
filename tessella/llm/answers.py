"""Problems 2 and 3: defective answers of translation models.

Limits. The lengths of all answers under several encodings (code points, UTF-8 bytes, UTF-16 units, entity escaping, JSON
escaping, converted line ends) are counted by model, and by model and target, without leaving the JVM. A hidden storage limit
shows as a pile of answers exactly as long that the lengths around do not share; windows over the counts find the piles, and
only those come to the driver. How far a pile stands above its neighbours is the prior odds that an answer of that length is
cut. Endings. An end-of-text n-gram model over all answers tells how often the last characters of an answer stand at an end
against anywhere. A second pass scores every answer beside its source:

* empty: no letter or digit is left, or a stand-in for nothing, while the source has something to say
* refusal: a wording of declining to translate, while the source has none
* copy: the source's letters and digits again, but for a little around them; sources of names, numerals or codes may stay
* wrong_language: by the language posteriors of a character n-gram naive Bayes of answer and source, neither the target's
  language nor the source's
* truncated: the likelihood ratio of an ending, from a logistic model of the end-of-text likelihood, of the length against the
  one its source's words foretell (a regression for each target) and of a missing closing mark, trained on answers cut by
  ourselves. At a storage limit it is weighed with the pile's odds; elsewhere, where only a broken transfer cuts, more is
  asked of it. ``cut_by`` tells which ("limit" or "ending"), ``limit_measure`` and ``limit_length`` the limit.

Classifiers are fitted on at most ``SAMPLE`` answers, spread over all by a hash; all counts cover all answers.
Defined results: answers without a source in the sentences are judged as empty or refusal only; answers of unknown targets as
empty, refusal or copy; of repeated rows the one loaded last counts; null models share one group of lengths.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.langid import LANGS, tag_language
from tessella.llm.normalize import _HAS_LATIN, _MIXED, _scripts
from tessella.session import cut, latest

SAMPLE = 24_000
#: Texts that are held as arrays at once on the driver.
CHUNK = 4_000
WORDS, GRAMS, ENDS = 1 << 14, 1 << 16, 1 << 21
#: Lengths of the end-of-text grams: with letters, and in scripts without blanks.
LONG, SHORT = (7, 4), (4, 2)
MEASURES = ("code_points", "utf8_bytes", "utf16_units", "entities", "json_escaped", "crlf")
#: Measures in which a character may take several units, so that a limit falls between two.
WIDE = (1, 3, 4)
#: A limit holds at least this many answers of exactly its length, this many times more than the lengths around have.
PILE, STEEP = 12, 4.0
#: No storage is narrower than so many units: piles at less are short answers that many sources share.
NARROWEST = 16
#: Log odds of a cut that are asked of an answer whose ending is open, and of one that ends well.
CUT = (0.2, 2.5)
#: What more is asked where a short source has no closing mark itself, as headings have none.
HEADING = 2.5

# --- fixed values: stand-ins for nothing
STAND_IN = re.compile(
    r"\W*(?:n\W?a|none|null|nil|nan|undefined|void|blank|tbd|todo|missing|empty|no (?:output|translation|text|answer|response|content|result)|empty (?:output|answer|response|string)|translation (?:missing|unavailable|here)|"
    r"not available|untranslated|leer|keine (?:ausgabe|übersetzung|antwort)|vide|aucune (?:sortie|traduction|réponse)|vacío|sin (?:salida|traducción|respuesta)|vazio|sem (?:saída|tradução|resposta)|пусто|нет (?:перевода|ответа|вывода|данных)|"
    r"порожньо|немає (?:перекладу|відповіді)|空|なし|無し|訳なし|無回答|翻訳なし|无|無|空白|无输出|无译文|暂无)\W*",
    re.I,
)
# --- fixed values: words that speak of the task itself, by which a refusal is suspected
CUES = (
    "translate translating translation translations render rendering passage request guidelines policy comply assist instructions language model ai safety unable decline breach withheld input content "
    "übersetzen übersetzung übertragen passage anfrage richtlinie richtlinien ki sprachmodell verweigert verarbeiten abschnitts abschnitt bearbeiten behilflich ablehnen eingabe "
    "traduire traduction requête demande passage modèle langage consignes règlement politique refuser refusée entrée "
    "traducir traducción solicitud pasaje modelo lenguaje normas política denegada fragmento rechazar atender procesar entrada "
    "traduzir tradução pedido passagem modelo linguagem regras política recusada recusar recusada trecho tratar "
    "перевод перевода перевести переводить запрос запросом запроса отрывка отрывок фрагмента языковая модель политика правилам отклонён отказаться обрабатывать "
    "переклад перекладу перекласти запит запитом запиту уривка уривок мовна модель політика правилами правила відхилено відмовитися обробляти "
    "翻译 翻譯 译文 请求 語言 语言 模型 政策 规则 拒绝 翻訳 訳出 訳す 訳せ 依頼 規約 方針 拒否 言語 控え"
).split()
# --- fixed values: wordings of declining, by language
DECLINE = re.compile(
    r"(?:can(?:no|')t|can not|cannot|could not|won't|will not|unable to|not able to|not allowed|not permitted|not comfortable|must decline|have to (?:pass|decline|refuse)|decline to|rather not|refuse to|would breach|against my|do not allow|don't allow|does not allow|withheld|refused|declined|no translation (?:can|is|will)|language model|"
    r"nicht (?:übersetzen|übertragen|bearbeiten|verarbeiten|behilflich|möglich|erlaub|gestatte)|darf ich|kann ich|verweigert|ablehnen|abgelehnt|sprachmodell|erlauben|"
    r"ne peux pas|ne puis|refus|impossible|ne m.autoris|modèle de langage|pas en mesure|pas autoris|"
    r"no puedo|no me (?:es posible|permiten)|rechazar|denegad|modelo de lenguaje|no (?:está|es) (?:permitid|posible)|"
    r"não (?:posso|consigo|me é|permitem|é possível|estou)|recus|modelo de linguagem|"
    r"не (?:могу|получится|разрешено|имею|вправе|буду|могу)|невозмож|отказ|отклон|языковая модель|помочь не|"
    r"не (?:можу|вдасться|дозвол|маю)|неможлив|відмов|відхил|мовна модель|"
    r"不能|无法|無法|不便|拒绝|不允许|语言模型|不予|できません|できない|控え|お断り|拒否|いたしかね|許可され|言語モデル|お手伝い)",
    re.I,
)
_TRAIL = re.compile(r"[\W_]+$")
_PURE = re.compile(r"(?:(?<=\s)|^)[\W_]*([^\W\d_]+(?:['’-][^\W\d_]+)*)[\W_]*(?=\s|$)")
_NO_CASE = re.compile("[֐-׿ऀ-ॿ฀-๿ぁ-ヿ一-鿿].*[֐-׿ऀ-ॿ฀-๿ぁ-ヿ一-鿿]")
_CLOSE = re.compile("[.!?…。！？।:;»”\"」』’)\\]）】]\\W*$")


@lru_cache(1)
def _tables():
    """By code point: the folded lower-case letter (0: not drawn), its class (0 other, 1 letter, 2 digit, 3 of a script without
    blanks), and what it adds to each length."""
    n = 0x110000
    fold = np.arange(n, dtype=np.uint32)
    kind = np.zeros(n, np.uint8)
    for cp in range(0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Cf" and cp != 0xFEFF or cp in (0xFEFF, 0x34F):
            fold[cp] = 0
            continue
        f = unicodedata.normalize("NFKC", c) if 0xFF00 <= cp < 0xFFF0 else c
        low = (f if len(f) == 1 else c).lower()
        if len(low) == 1:
            fold[cp] = ord(low)
        k = ord(low) if len(low) == 1 else cp
        bare = 0xE00 <= k < 0xE80 or 0x3041 <= k < 0x3100 or 0x3400 <= k < 0xA000 or 0xF900 <= k < 0xFB00
        kind[cp] = 3 if bare and cat[0] in "LM" else 1 if cat[0] in "LM" else 2 if cat[0] == "N" else 0
        if c.isspace():
            fold[cp] = 32
    out = np.ones((len(MEASURES), n), np.uint8)
    at = np.arange(n)
    out[1] = 1 + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000)
    out[2] = 1 + (at >= 0x10000)
    for c, size in (("&", 5), ("<", 4), (">", 4), ('"', 6), ("'", 5)):
        out[3, ord(c)] = size
    out[4] = np.where(at < 0x20, 6, np.where(at < 0x80, 1, np.where(at < 0x10000, 6, 12)))
    for c in '"\\\n\t\r':
        out[4, ord(c)] = 2
    out[5, 10] = 2
    return fold, kind, out


_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, _R)), np.multiply.accumulate(np.full(n, _INVERSE))


class Texts:
    """A batch of texts as one array of folded characters without the undrawn ones, with hashes of any range at hand."""

    def __init__(self, texts: list[str], measures: bool = False):
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        fold, kind, weight = _tables()
        self.n = len(texts)
        row = np.repeat(np.arange(self.n), sizes)
        if measures:
            self.lengths = np.stack([np.bincount(row, weight[m][raw], self.n).astype(np.int64) for m in range(len(MEASURES))])
        c = fold[raw]
        shown = c > 0
        self.c, self.row, self.kind = c[shown], row[shown], kind[raw[shown]]
        self.at = np.searchsorted(self.row, np.arange(self.n + 1))
        size = 1 << max(10, int(len(self.c) + 8).bit_length())
        up, down = _powers(size)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([[np.uint64(0)], np.cumsum((self.c.astype(np.uint64) + np.uint64(1)) * up[: len(self.c)], dtype=np.uint64)])
        self.down = down

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[b] - self.total[a]) * self.down[a]
            h ^= h >> np.uint64(29)
            return h * np.uint64(0xBF58476D1CE4E5B9)

    def ends(self) -> np.ndarray:
        """Behind each text's last letter or digit; its start where there is none."""
        last = np.maximum.accumulate(np.where(self.kind > 0, np.arange(1, len(self.c) + 1), 0)) if len(self.c) else np.zeros(0, int)
        out = np.where(self.at[1:] > self.at[:-1], last[np.maximum(self.at[1:] - 1, 0)] if len(last) else 0, 0)
        return np.maximum(out, self.at[:-1])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, start, end and hash of each word; in scripts without blanks each character and each pair of them is one."""
        k, first = self.kind, np.zeros(len(self.c) + 1, bool)
        first[self.at[:-1]] = True
        before = np.concatenate([[0], k[:-1]]) if len(k) else k
        joined = (k == before) & ~first[:-1]
        start = np.flatnonzero(((k == 1) | (k == 2)) & ~joined)
        nxt = np.concatenate([k[1:], [0]]) if len(k) else k
        end = np.flatnonzero(((k == 1) | (k == 2)) & ~((nxt == k) & ~first[1:])) + 1
        single = np.flatnonzero(k == 3)
        pair = np.flatnonzero((k == 3) & joined)
        a, b = np.concatenate([start, single, pair - 1]), np.concatenate([end, single + 1, pair + 1])
        return self.row[a] if len(a) else a, a, b, self.hash(a, b)

    def grams(self, positions: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k characters that end at each position, fewer at a text's beginning."""
        lo = self.at[self.row[positions - 1]]
        return self.hash(np.maximum(positions - k, lo), positions) + np.uint64(k)

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of each character trigram that ends in a letter."""
        p = np.flatnonzero((self.kind == 1) | (self.kind == 3)) + 1
        return (self.row[p - 1] if len(p) else p), (self.grams(p, 3) >> np.uint64(48)).astype(np.int64) if len(p) else p

    def letters(self) -> np.ndarray:
        """A hash of each text's letters and digits, 0 where it has none."""
        p = np.flatnonzero(self.kind > 0)
        r = self.row[p]
        rank = np.arange(len(p)) - np.searchsorted(p, self.at[:-1])[r]
        up, _ = _powers(1 << max(10, int(len(self.c) + 8).bit_length()))
        with np.errstate(over="ignore"):
            out = np.zeros(self.n, np.uint64)
            if len(p):
                some = np.unique(r)
                out[some] = np.add.reduceat((self.c[p].astype(np.uint64) + np.uint64(1)) * up[rank], np.searchsorted(r, some))
        return out


def _end_buckets(t: Texts, positions: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the longer and the shorter gram at each position, apart by target."""
    bare = t.kind[positions - 1] == 3
    salt = (target.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for a, b in zip(LONG, SHORT):
        with np.errstate(over="ignore"):
            h = np.where(bare, t.grams(positions, b), t.grams(positions, a)) ^ salt
            h *= np.uint64(0x94D049BB133111EB)
        out.append((h >> np.uint64(43)).astype(np.int64))
    return tuple(out)


_TARGET = {c: i for i, c in enumerate(LANGS)}


def _targets(col) -> np.ndarray:
    return np.array([_TARGET.get(x, -1) for x in col], np.int64)


def _gather(batches):
    """Gram counts by kind (0, 1 anywhere, longer and shorter; 2, 3 at an end) and bucket."""
    dense = np.zeros((4, ENDS), np.int32)
    for b in batches:
        col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
        t = Texts([x or "" for x in col("text")])
        tg = _targets(col("target"))
        p = np.flatnonzero(t.kind > 0) + 1
        if len(p):
            for j, k in enumerate(_end_buckets(t, p, tg[t.row[p - 1]])):
                dense[j] += np.bincount(k, minlength=ENDS).astype(np.int32)
            e = t.ends()
            some = e > t.at[:-1]
            for j, k in enumerate(_end_buckets(t, e[some], tg[some])):
                dense[2 + j] += np.bincount(k, minlength=ENDS).astype(np.int32)
    kinds, keys = np.nonzero(dense)
    if len(keys):
        yield pa.RecordBatch.from_arrays([pa.array((kinds * ENDS + keys).astype(np.int32)), pa.array(dense[kinds, keys].astype(np.int64))], ["k", "n"])


def counts(answers: DataFrame) -> np.ndarray:
    """Over all answers: gram counts in a fixed number of buckets."""
    got = answers.select("target", "text").mapInArrow(_gather, "k int, n long").groupBy("k").agg(F.sum("n").cast("int").alias("n"))
    # of grams seen once or twice only their ends tell anything; they count as often as they end
    got = got.where((F.col("k") >= 2 * ENDS) | (F.col("n") >= 3))
    grams = np.zeros((4, ENDS), np.float32)
    for b in got.toArrow().to_batches():
        k = b.column(0).to_numpy()
        grams[k // ENDS, k % ENDS] = b.column(1).to_numpy()
    grams[:2] = np.maximum(grams[:2], grams[2:])
    return grams


def lengths(text) -> list:
    """Columns: the lengths of a text under each of MEASURES."""
    n = F.length(text)
    without = lambda p: n - F.length(F.regexp_replace(text, p, ""))
    one = lambda c: n - F.length(F.replace(text, F.lit(c), F.lit("")))
    far, wide = without("[\\x{10000}-\\x{10FFFF}]"), without("[^\\x00-\\x7F]")
    pairs = without('["\\\\\n\t\r]')
    return [
        n, F.octet_length(text), n + far, n + 4 * one("&") + 3 * one("<") + 3 * one(">") + 5 * one('"') + 4 * one("'"),
        n + 5 * wide + 6 * far + pairs + 5 * without("[\\x00-\\x1F&&[^\n\t\r]]"), n + one("\n"),
    ]


def length_counts(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, measure (its number), length, n: how many answers have each length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.posexplode(F.array(*lengths(text))).alias("measure", "length")
    return answers.select(*by, each).groupBy(*by, "measure", "length").agg(F.count("*").alias("n"))


def piles(counted: DataFrame, by: list[str]) -> DataFrame:
    """counted: by, measure, length, n. The lengths at which answers pile up: by, measure, length, n (answers of this length or,
    where a character takes several units, up to three less), odds (against what the lengths around have), own (whether the
    last length alone is a pile)."""
    near = Window.partitionBy(*by, "measure").orderBy("length")
    width = F.when(F.col("measure").isin(*WIDE), 4).otherwise(1)
    total = lambda a, b: F.coalesce(F.sum("n").over(near.rangeBetween(a, b)), F.lit(0))
    pile = F.when(width == 4, total(-3, 0)).otherwise(F.col("n"))
    around = F.when(width == 4, total(-19, -5) + total(5, 19)).otherwise(total(-16, -2) + total(2, 16))
    x = counted.select("*", pile.alias("pile"), (around / 30.0).alias("usual"), width.alias("width"))
    x = x.where((F.col("length") >= NARROWEST) & (F.col("pile") >= PILE) & (F.col("pile") > STEEP * (F.col("usual") * F.col("width") + 1)))
    odds = F.greatest(F.col("pile") / (F.col("usual") * F.col("width") + 1) - 1, F.lit(1.0))
    own = (F.col("n") >= PILE) & (F.col("n") > STEEP * (F.col("usual") + 1))
    return x.select(*by, "measure", "length", F.col("pile").alias("n"), odds.alias("odds"), own.alias("own"))


def limits(found: list[tuple]) -> dict[tuple, dict[int, float]]:
    """found: (group, measure, length, n, odds, own) of piles. Storage limits: (group, measure) to the log odds of a cut by length.
    Limits in bytes fall short by up to three where a character would have been split. Of piles that share lengths the largest
    counts, and each other one that its last length makes up by itself."""
    out: dict[tuple, dict[int, float]] = {}
    for group, m, top, _, odds, own in sorted(found, key=lambda x: (-x[3], x[2])):
        kept = out.setdefault((group, m), {})
        if own or all(abs(top - x) >= (4 if m in WIDE else 1) for x in kept):
            kept[top] = float(np.log(odds))
    return out


def storage_limits(answers: DataFrame, levels: list[list[str]]) -> dict[tuple, dict[int, float]]:
    """The limits of the groups of every level, the columns of the last holding those of the others. Lengths are counted once; only
    piles come to the driver."""
    counted = cut(length_counts(answers, levels[-1]))
    out: dict[tuple, dict[int, float]] = {}
    for by in levels:
        rows = piles(counted.groupBy(*by, "measure", "length").agg(F.sum("n").alias("n")), by).collect()
        out |= limits([(tuple(r[c] for c in by), r.measure, r.length, r.n, r.odds, r.own) for r in rows])
    return out


def _cg(i: np.ndarray, j: np.ndarray, y: np.ndarray, n: int, ridge: float = 2.0, steps: int = 40) -> np.ndarray:
    """Ridge regression on sparse counts by conjugate gradients."""
    forth = lambda x: np.bincount(i, x[j], len(y))
    back = lambda r: np.bincount(j, r[i], n)
    x, r = np.zeros(n), back(y)
    p, rs = r.copy(), r @ r
    for _ in range(steps):
        q = back(forth(p)) + ridge * p
        a = rs / max(p @ q, 1e-12)
        x += a * p
        r -= a * q
        new = r @ r
        if new < 1e-4:
            break
        p, rs = r + new / rs * p, new
    return x


def _word_buckets(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    row, _, _, h = t.words()
    return np.concatenate([row, np.arange(t.n)]), np.concatenate([(h >> np.uint64(50)).astype(np.int64), np.zeros(t.n, np.int64)])


class Model:
    """All that the second pass needs; of a fixed size but for the limits found. found: by model, and by model and target."""

    def __init__(self, grams, found, nb, length, spread, weights):
        self.grams, self.found, self.nb, self.length, self.spread, self.weights = grams, found, nb, length, spread, weights
        self.cues = np.unique(np.concatenate([Texts([w]).words()[3][-1:] for w in CUES]))

    def end_likelihood(self, t: Texts, target: np.ndarray) -> np.ndarray:
        """log P(end | last characters), from the longer and the shorter gram; two columns."""
        e = t.ends()
        some = np.flatnonzero(e > t.at[:-1])
        out = np.zeros((t.n, 2))
        if len(some):
            for j, k in enumerate(_end_buckets(t, e[some], target[some])):
                out[some, j] = np.log((self.grams[2 + j][k] + 0.02) / (self.grams[j][k] + 2.0))
        return out

    def languages(self, t: Texts) -> np.ndarray:
        """Log posteriors up to a constant, texts x languages."""
        row, k = t.trigrams()
        out = np.zeros((t.n, len(LANGS)))
        if len(row):
            some = np.unique(row)
            out[some] = np.add.reduceat(self.nb[k], np.searchsorted(row, some), axis=0)
        return out

    def foretold(self, source: Texts, target: np.ndarray) -> np.ndarray:
        row, k = _word_buckets(source)
        return np.bincount(row, self.length[target[row], k], source.n)

    def features(self, t: Texts, source: Texts, target: np.ndarray, open_end: np.ndarray) -> np.ndarray:
        end = self.end_likelihood(t, target)
        want = np.maximum(self.foretold(source, target), 6)
        short = np.clip((t.ends() - t.at[:-1] - want) / np.hypot(self.spread[0, target] * want, self.spread[1, target]), -12, 6)
        return np.column_stack([np.ones(t.n), np.maximum(end, -7), np.minimum(short, 0), np.minimum(short, 0) ** 2 / 10, open_end, open_end[:, 0] * np.minimum(short, 0)])


_HANGS = re.compile(r"[,;:、，；：—–(\[«„“「『¿¡-]\s*$")
_PAIRS = ("()", "[]", "«»", "「」", "『』", "【】")


def _unclosed(x: str) -> bool:
    """Whether a bracket or quotation is opened and not closed."""
    return any(a in x and x.count(a) > x.count(b) for a, b in _PAIRS) or ("“" in x and "„" not in x and x.count("“") > x.count("”")) or ("„" in x and x.count("„") > x.count("“"))


def _open_end(texts: list[str], sources: list[str]) -> np.ndarray:
    """Whether the source ends in a mark and the answer does not; whether the answer ends in a mark that needs more to come;
    whether it leaves a bracket or quotation open that the source closes."""
    out = np.zeros((len(texts), 3))
    for i, (t, s) in enumerate(zip(texts, sources)):
        out[i, 0] = not _CLOSE.search(t[-12:]) and bool(_CLOSE.search(s[-12:]))
        out[i, 1] = bool(_HANGS.search(t[-6:])) and not _HANGS.search(s[-6:])
        out[i, 2] = _unclosed(t) and not _unclosed(s)
    return out


def _spans(n: int):
    return [slice(i, min(n, i + CHUNK)) for i in range(0, n, CHUNK)]


def _naive_bayes(texts: list[str], label: np.ndarray) -> np.ndarray:
    n = np.full((GRAMS, len(LANGS)), 0.02)
    for at in _spans(len(texts)):
        row, k = Texts(texts[at]).trigrams()
        own = label[at]
        keep = own[row] >= 0
        np.add.at(n, (k[keep], own[row[keep]]), 1.0)
    return np.log(n / n.sum(0)).astype(np.float32)


def train(rows, grams, found) -> Model:
    """rows: (text, target, source, book, label of the book). Language model, length regression, and the cut classifier."""
    rng = np.random.default_rng(0)
    texts, sources = [r[0] or "" for r in rows], [r[2] or "" for r in rows]
    target = _targets([r[1] for r in rows])
    label = _targets([r[4] for r in rows])
    books = np.unique(np.array([r[3] if r[3] is not None else -1 for r in rows], np.int64), return_inverse=True)[1]
    spans = _spans(len(rows))
    nb = None
    for _ in range(2):  # false labels of books go in the second round
        nb = _naive_bayes(texts + sources, np.concatenate([target, label]))
        model = Model(grams, found, nb, None, None, None)
        score = np.zeros((books.max() + 1 if len(books) else 1, len(LANGS)))
        for at in spans:
            np.add.at(score, books[at], model.languages(Texts(sources[at])))
        label = score.argmax(1)[books]
    own, size, same, row, k = [], [], [], [], []
    for at in spans:
        t, s = Texts(texts[at]), Texts(sources[at])
        own.append(model.languages(t).argmax(1))
        size.append((t.ends() - t.at[:-1]).astype(float))
        same.append(s.letters() == t.letters())
        r, w = _word_buckets(s)
        row.append(r + at.start), k.append(w)
    own, size, same, row, k = (np.concatenate(x) if x else np.zeros(0, int) for x in (own, size, same, row, k))
    length, spread = np.zeros((len(LANGS), WORDS)), np.tile([[0.05], [4.0]], len(LANGS))
    half = np.arange(len(rows)) % 2 == 0  # lengths are learnt on one half, cuts on the other
    sound = np.zeros(len(rows), bool)
    closed = _open_end(texts, sources).sum(1) == 0
    for g in np.unique(target[target >= 0]):
        all_ = (target == g) & (own == g) & (size > 3) & ~same
        use = np.flatnonzero(all_ & half)
        if len(use) < 50:
            length[g, 0] = np.median(size[use]) if len(use) else 60
            continue
        for _ in range(3):
            place = np.full(len(rows), -1)
            place[use] = np.arange(len(use))
            in_ = place[row] >= 0
            length[g] = _cg(place[row[in_]], k[in_], size[use], WORDS)
            want = np.maximum(np.bincount(row, length[g, k], len(rows)), 6)
            rest = (size - want) / want
            held = np.flatnonzero(all_ & ~half)
            big = np.median(want[held]) if len(held) else 40
            of = lambda x, least: max(least, 1.5 * np.median(x)) if len(x) else least
            spread[0, g] = of(np.abs(rest[held][want[held] >= big]), 0.02)
            spread[1, g] = of(np.abs(size - want)[held][want[held] < big], 1.0)
            use = np.flatnonzero(all_ & half & (np.abs(size - want) < 4 * np.hypot(spread[0, g] * want, spread[1, g])))
        sound |= all_ & ~half & closed
    model = Model(grams, found, nb, length, spread, None)
    # answers cut by ourselves at 15 to 97 per cent, sometimes closed again, against the sound ones; a missing mark is no cut
    x, y = [], []
    for at in spans:
        ids = at.start + np.flatnonzero(sound[at])
        src, whole, tg = [sources[i] for i in ids], [texts[i] for i in ids], target[ids]
        full = [_TRAIL.sub("", w) if rng.random() < 0.4 else w for w in whole]
        cut = [w[: max(3, int(len(w) * rng.uniform(0.15, 0.97)))].rstrip() + rng.choice(["", "", "", "", "...", ".", "…", " [...]"]) for w in whole]
        s = Texts(src)
        for kind, xs in enumerate((full, cut)):
            x.append(model.features(Texts(xs), s, tg, _open_end(xs, src)))
            y.append(np.full(len(xs), float(kind)))
    if not sound.any():  # nothing to learn from: no answer is held to be cut
        model.weights = np.array([-9.0] + [0.0] * 8)
        return model
    x, y = np.concatenate(x), np.concatenate(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps, lightly regularised
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1.0
        w += np.linalg.solve(h, x.T @ (y - p) - 1.0 * w)
    model.weights = w
    return model


def fit(answers: DataFrame, sentences: DataFrame, books: DataFrame, sample: int = SAMPLE) -> Model:
    grams, found = counts(answers), storage_limits(answers, [["model"], ["model", "target"]])
    step = max(1, -(-answers.count() // sample))
    pick = lambda df: df.where(F.pmod(F.xxhash64("sentence_id"), F.lit(step)) == 0)
    some = pick(answers).select("sentence_id", "text", "target").join(pick(sentences).select("sentence_id", "book_id", "src").dropDuplicates(["sentence_id"]), "sentence_id")
    rows = some.join(books.select("book_id", tag_language(F.col("language")).alias("label")), "book_id", "left").orderBy(F.xxhash64("sentence_id", "text", "target")).limit(2 * sample).collect()
    return train([(r.text, r.target, r.src, r.book_id, r.label) for r in rows], grams, found)


def _wording(s: str) -> bool:
    """Whether a source holds more than names, numerals, marks and codes."""
    if _NO_CASE.search(s):
        return True
    words = [w for w in _PURE.findall(s) if len(w) > 1]
    return any(w[0].islower() for w in words) or sum(w.isupper() and len(w) > 2 for w in words) >= 3


_CUES = frozenset(CUES)


def _of_task(s: str) -> bool:
    """Whether a source itself speaks of translating and the like; a character who declines doesn't."""
    return not _CUES.isdisjoint(re.findall(r"[^\W\d_]+", s.lower())) or any(c in s for c in CUES if c > "\u3000")


_LETTERS = re.compile(r"[\W_]+")


def _bare(s: str) -> str:
    return _LETTERS.sub("", unicodedata.normalize("NFKC", s)).lower()


def _plain(x: str | None) -> str:
    """Look-alike letters of another script are brought home."""
    return "" if not x else _scripts(x) if not x.isascii() and _MIXED.search(x) and _HAS_LATIN.search(x) else x


def _at_limit(found: dict, model: str | None, target: str | None, lengths: np.ndarray) -> tuple[float, int, int] | None:
    """(log odds, measure, length) of the steepest limit that an answer of these lengths stands at."""
    best = None
    for m in range(len(MEASURES)):
        for group in ((model,), (model, target)):
            for top, odds in found.get((group, m), {}).items():
                if top - (3 if m in WIDE else 0) <= lengths[m] <= top and (best is None or odds > best[0]):
                    best = odds, m, top
    return best


def _judge(model, keep: list[str]):
    def run(batches):
        m = model.value
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            told, models, targets = col("src"), col("model"), col("target")
            texts, sources = [_plain(x) for x in col("text")], [x or "" for x in told]
            target = _targets(targets)
            t, s = Texts(texts, measures=True), Texts(sources)
            tl, sl = t.letters(), s.letters()
            ll = m.languages(t)
            lang = ll.argmax(1)
            known = target >= 0
            tg = np.where(known, target, 0)
            margin = ll.max(1) - ll[np.arange(t.n), tg]
            ending = _open_end(texts, sources)
            ratio = m.features(t, s, tg, ending) @ m.weights
            asked = np.where(ending.any(1), *CUT)
            asked += HEADING * np.array([len(x) <= 36 and not (_CLOSE.search(x[-12:]) or "฀" <= x.rstrip()[-1:] <= "๿") for x in sources])
            # at a limit the pile's odds speak for a cut, and nothing more is asked of an ending without a closing mark; storage
            # cuts anywhere and seldom behind one
            limit = [_at_limit(m.found, mo, ta, t.lengths[:, i]) for i, (mo, ta) in enumerate(zip(models, targets))]
            p = ratio - asked
            for i, x in enumerate(limit):
                if x:
                    p[i] = max(p[i], ratio[i] + x[0] - CUT[1] * bool(_CLOSE.search(texts[i][-12:])))
            row, _, _, h = t.words()
            cue = np.bincount(row[np.isin(h, m.cues)], minlength=t.n) > 0
            out: list[str | None] = [None] * t.n
            for i in range(t.n):
                src, txt = sources[i], texts[i]
                foreign = not known[i] or lang[i] != target[i]
                if tl[i] == 0 or len(txt) < 48 and STAND_IN.fullmatch(txt):
                    if told[i] is None or sl[i] != 0 and not STAND_IN.fullmatch(src):
                        out[i] = "empty"
                elif tl[i] == sl[i]:
                    if _wording(src):
                        out[i] = "copy"
                elif cue[i] and DECLINE.search(txt) and not (DECLINE.search(src) and _of_task(src)):
                    out[i] = "refusal"
                elif told[i] is None:
                    pass
                elif foreign and (margin[i] > 3 or not known[i]):
                    a, c = _bare(src), _bare(txt)
                    if not _wording(src):
                        pass
                    elif a and (a in c and len(c) - len(a) <= max(12, 0.3 * len(a)) or len(c) >= 0.8 * len(a) and c in a):
                        out[i] = "copy"
                    elif known[i] and margin[i] > 3 + 0.02 * len(txt):
                        ps = m.languages(Texts([src]))[0]
                        if int(ps.argmax()) != int(lang[i]):
                            out[i] = "wrong_language"
                elif p[i] > 0 and known[i]:
                    out[i] = "truncated"
            rows = [i for i, d in enumerate(out) if d]
            kept = b.take(pa.array(rows, pa.int32()))
            score = 1 / (1 + np.exp(-np.clip(p[rows], -30, 30)))
            at = [limit[i] if out[i] == "truncated" else None for i in rows]
            yield pa.RecordBatch.from_arrays([
                *(kept.column(kept.schema.get_field_index(c)) for c in keep), pa.array([out[i] for i in rows], pa.string()), pa.array(score),
                pa.array([("limit" if a else "ending") if out[i] == "truncated" else None for a, i in zip(at, rows)], pa.string()),
                pa.array([MEASURES[a[1]] if a else None for a in at], pa.string()), pa.array([a[2] if a else None for a in at], pa.int32()),
            ], [*keep, "defect", "cut_score", "cut_by", "limit_measure", "limit_length"])

    return run


def defects(answers: DataFrame, sentences: DataFrame, books: DataFrame, keep: tuple[str, ...] = ("translation_id",), model: Model | None = None) -> DataFrame:
    """The defective answers with the kind of defect; one row an answer. answers: translation_id, sentence_id, model, target, text
    and, where rows may be repeated, loaded_at, as the sentences."""
    model = model or fit(answers, sentences, books)
    ship = answers.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([*keep, "translation_id", "sentence_id", "model", "target", "text", *(c for c in ("loaded_at",) if c in answers.columns)]))
    src = latest(sentences.select("sentence_id", "src", *(c for c in ("loaded_at",) if c in sentences.columns)), "sentence_id").select("sentence_id", "src")
    # repeated answers have the same sentence, so they are told apart where the join has put them
    both = latest(answers.select(*cols).join(src, "sentence_id", "left"), "translation_id", within=["sentence_id"])
    schema = both.select(*keep, F.lit("").alias("defect"), F.lit(0.0).alias("cut_score"), *[F.lit(None).cast(t).alias(c) for c, t in (("cut_by", "string"), ("limit_measure", "string"), ("limit_length", "int"))]).schema
    return both.mapInArrow(_judge(ship, list(keep)), schema)

"""Problem 6: the language of books, documents and lines, by segmentation-marginalised unigrams.

Model. The pieces of a fixed public vocabulary have a probability in each language. The probability of a unit of text is
the sum over all its segmentations into pieces, by the forward algorithm, for all languages at once. Units are words (with
the vocabulary's word mark), scored whole however long, and in scripts without blanks (Han, kana, Thai) the blocks of a run
between the places that no piece of several characters crosses: there the sum over all segmentations is a product, so the
blocks' scores add up to the run's. A line's score is the sum over its units, and every distinct unit is scored once a worker.
Training. Piece probabilities are fitted by expectation maximisation on a sample of at most ``SAMPLE`` sentences whose
book carries a language label; as labels may be false, the sampled books are relabelled by the first fit and fitted again.

Confidence is the posterior of the language, its log likelihoods divided by the root of the number of units, as units of a
line are not independent.

Defined results: a document without letters has no language and confidence (null) and is not wrong; null labels and texts are handled as missing; a tie of line
counts goes to the language likelier over all lines; a book without scored sentences gets no row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "ru", "de", "fr", "es", "ja", "zh", "uk", "pt", "lt", "he", "hi", "th")
#: Tags of these languages of two or three letters, old and bibliographic ones included.
TAGS = {
    "en": "en eng", "ru": "ru rus", "de": "de deu ger", "fr": "fr fra fre", "es": "es spa", "ja": "ja jpn", "zh": "zh zho chi cmn", "uk": "uk ukr", "pt": "pt por",
    "lt": "lt lit", "he": "he heb iw", "hi": "hi hin", "th": "th tha",
}
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MULTILINGUAL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE = 20_000
#: A line counts as of another language than its document's when that is likelier by this many nats.
MARGIN = 4.0
ROUNDS = 2
UNKNOWN, SMOOTH = 1e-7, 0.02
#: Longer units are learnt from in parts of so many characters.
TRAINED = 48
#: Characters after which the forward probabilities of a unit are rescaled.
RESCALE = 24

_NO_BLANKS = "ぁ-ヿ一-鿿㐀-䶿฀-๿"
_UNITS = re.compile(f"[{_NO_BLANKS}]+|[ऀ-ॣॱ-ॿ]+|[^\\W\\d_{_NO_BLANKS}ऀ-ॿ]+")
_BARE = re.compile(f"[{_NO_BLANKS}]")
_ADDRESS = re.compile(r"\S*(?:@|://|www\.)\S*")


class Splitter:
    """Texts to units, by a vocabulary."""

    def __init__(self, index: dict[str, int]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for p in index:
            if len(p) > 1 and _BARE.match(p):
                self.found.add_word(p, len(p))
        if len(self.found):
            self.found.make_automaton()

    def blocks(self, run: str) -> list[str]:
        """A run of a script without blanks, cut wherever no piece crosses."""
        joined = bytearray(len(run))  # 1: a piece goes on from the character before
        if len(self.found):
            for last, n in self.found.iter(run):
                joined[last - n + 2 : last + 1] = b"\1" * (n - 1)
        cuts = [i for i, x in enumerate(joined) if not x]
        return [run[a:b] for a, b in zip(cuts, [*cuts[1:], len(run)])]

    def units(self, text: str) -> list[str]:
        """The units of a text; mail and web addresses are of no language."""
        if "@" in text or "://" in text or "www." in text:
            text = _ADDRESS.sub(" ", text)
        found = _UNITS.findall(text.lower())
        if not _BARE.search(text):
            return found
        return [u for x in found for u in (self.blocks(x) if _BARE.match(x) else (x,))]


def pieces(path: str = VOCABULARY, more: str = MULTILINGUAL) -> dict[str, int]:
    """The vocabulary's pieces, lower case ones only, as texts are; and of a second one those of scripts without blanks, of which
    the first has hardly any longer than a character."""
    import base64

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) and (p := sp.id_to_piece(i)) == p.lower()]
    whole = re.compile(f"[{_NO_BLANKS}]+")
    with open(more, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip()
            if whole.fullmatch(token):
                kept.append(token)
    return {p: i for i, p in enumerate(dict.fromkeys(kept))}


class Model:
    """Piece probabilities, pieces x languages, and the units scored so far."""

    KEEP = 400_000

    def __init__(self, index: dict[str, int], p: np.ndarray):
        self.index, self.p, self.longest = index, p, max(map(len, index))
        self.split = Splitter(index)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, p.shape[1]))

    def __reduce__(self):
        return Model, (self.index, self.p)

    def edges(self, unit: str):
        """Text with its word mark, and the pieces (from, to, row) of its lattice; row -1 for an unknown character."""
        s = unit if _BARE.match(unit) else "▁" + unit
        out = []
        for j in range(1, len(s) + 1):
            found = [(i, j, r) for i in range(max(0, j - self.longest), j) if (r := self.index.get(s[i:j])) is not None]
            out += found if any(i == j - 1 for i, _, _ in found) else [*found, (j - 1, j, -1)]
        return s, out

    def forward(self, unit: str) -> np.ndarray:
        """log P(unit) in each language, all segmentations summed."""
        s, edges = self.edges(unit)
        a = np.zeros((len(s) + 1, self.p.shape[1]))
        a[0], scale, due = 1, 0.0, RESCALE
        for i, j, r in edges:
            if j > due:  # a long unit's probabilities are brought back into range, those that later edges still need
                due += RESCALE
                near = a[max(0, j - self.longest) : j]
                top = np.maximum(near.max(0), 1e-300)
                near /= top
                scale = scale + np.log(top)
            a[j] += a[i] * (self.p[r] if r >= 0 else UNKNOWN)
        return np.log(np.maximum(a[-1], 1e-300)) + scale

    def ids(self, found: list[str]) -> list[int]:
        rows = self.rows
        try:
            return [rows[u] for u in found]
        except KeyError:
            pass
        for u in found:
            if u not in rows:
                if len(rows) == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[len(rows)] = self.forward(u)
                rows[u] = len(rows)
        return [rows[u] for u in found]

    def total(self, counts: Counter) -> np.ndarray:
        ids = self.ids(list(counts))
        return (self.table[ids] * np.array(list(counts.values()))[:, None]).sum(0)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, texts x languages, and the number of units."""
        if len(self.rows) > self.KEEP:
            self.rows, self.table = {}, np.zeros((1024, self.p.shape[1]))
        ids: list[int] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for k, t in enumerate(texts):
            if t:
                ids += self.ids(self.split.units(t))
            ends[k + 1] = len(ids)
        out = np.zeros((len(texts), self.p.shape[1]))
        n = np.diff(ends)
        if ids:
            full = n > 0
            out[full] = np.add.reduceat(self.table[ids], ends[:-1][full], axis=0)
        return out, n


def _em(index, by_unit: dict[str, np.ndarray], rounds: int) -> Model:
    model = Model(index, np.full((len(index), len(LANGS)), 1e-4))
    for _ in range(rounds):
        got = np.full(model.p.shape, SMOOTH)
        for u, w in by_unit.items():
            s, edges = model.edges(u)
            a, b = np.zeros((len(s) + 1, len(LANGS))), np.zeros((len(s) + 1, len(LANGS)))
            a[0], b[-1] = 1, 1
            for i, j, r in edges:
                a[j] += a[i] * (model.p[r] if r >= 0 else UNKNOWN)
            for i, j, r in reversed(edges):
                b[i] += b[j] * (model.p[r] if r >= 0 else UNKNOWN)
            z = w / np.maximum(a[-1], 1e-300)
            for i, j, r in edges:
                if r >= 0:
                    got[r] += a[i] * model.p[r] * b[j] * z
        model = Model(index, got / got.sum(0))
    return model


def train(rows: list[tuple[object, str | None, str | None]], path: str = VOCABULARY) -> Model:
    """rows: (group, label or None, text). Fits, relabels the groups, fits again."""
    index = pieces(path)
    split = Splitter(index)
    groups: dict[object, Counter] = defaultdict(Counter)
    labels = {}
    for g, label, text in rows:
        groups[g].update(part for u in split.units(text or "") for part in (u[i : i + TRAINED] for i in range(0, len(u), TRAINED)))
        labels[g] = label if label in LANGS else None
    model = None
    for _ in range(2):
        by_unit: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGS)))
        for g, counts in groups.items():
            if labels[g]:
                at = LANGS.index(labels[g])
                for u, n in counts.items():
                    by_unit[u][at] += n
        model = _em(index, by_unit, ROUNDS)
        for g, counts in groups.items():
            if counts:
                labels[g] = LANGS[int(model.total(counts).argmax())]
    return model


def tag_language(label):
    """Column: the two-letter language of a label that is a tag of a known language, else null."""
    known = F.create_map(*[F.lit(x) for lang, tags in TAGS.items() for tag in tags.split() for x in (tag, lang)])
    low = F.lower(F.trim(label))
    return F.when(low.rlike("^[a-z]{2,3}([-_][a-z0-9]{1,8})*$"), F.try_element_at(known, F.regexp_extract(low, "^[a-z]+", 0)))


def fit(sentences: DataFrame, books: DataFrame, sample: int = SAMPLE, path: str = VOCABULARY) -> Model:
    """Fits on at most ``sample`` sentences of labelled books, spread over all sentences by a hash of their id."""
    step = max(1, -(-sentences.count() // sample))
    some = sentences.where(F.pmod(F.xxhash64("sentence_id"), F.lit(step)) == 0).select("book_id", "src")
    rows = some.join(books.select("book_id", tag_language(F.col("language")).alias("label")), "book_id").orderBy(F.xxhash64("book_id", "src")).limit(2 * sample).collect()
    return train([(r.book_id, r.label, r.src) for r in rows], path)


def _posterior(ll: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = ll / np.sqrt(np.maximum(n, 1))[:, None]
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def text_languages(df: DataFrame, model: Model, text: str) -> DataFrame:
    """Replaces ``text`` by lang and confidence; rows without letters go."""
    keep = [c for c in df.columns if c != text]
    ship = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = ship.value
        for b in batches:
            ll, n = m.scores(b.column(b.schema.get_field_index(text)).to_pylist())
            conf, best, ok = _posterior(ll, n).max(1), ll.argmax(1), n > 0
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.column(kept.schema.get_field_index(c)) for c in keep), pa.array([LANGS[i] for i in best[ok]], pa.string()), pa.array(conf[ok])], [*keep, "lang", "confidence"])

    return df.mapInArrow(run, df.select(*keep, F.lit("").alias("lang"), F.lit(0.0).alias("confidence")).schema)


def document_languages(df: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """df: doc_id, label, text. One row a document (line_no 0) with its main language, the language of most of its lines, and one a
    line of another language; lines are split at line feeds and counted from 1, blank ones included."""
    ship = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = ship.value
        for b in batches:
            ids, nos, langs, confs, labels = [], [], [], [], []
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            lines = [(t or "").split("\n") for t in texts]
            ll, n = m.scores([x for ls in lines for x in ls])
            post, best = _posterior(ll, n), ll.argmax(1)
            at = 0
            docs, said = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "label"))
            for doc, label, ls in zip(docs, said, lines):
                own = [i for i in range(at, at + len(ls)) if n[i]]
                at += len(ls)
                if not own:
                    ids.append(doc), nos.append(0), langs.append(None), confs.append(None), labels.append(label)
                    continue
                votes = np.bincount(best[own], minlength=len(LANGS))
                total = ll[own].sum(0)
                main = max(range(len(LANGS)), key=lambda k: (votes[k], total[k]))
                ids.append(doc), nos.append(0), langs.append(LANGS[main]), confs.append(float(post[own, main].mean())), labels.append(label)
                for i in own:
                    if best[i] != main and ll[i, best[i]] - ll[i, main] > margin:
                        ids.append(doc), nos.append(i - (at - len(ls)) + 1), langs.append(LANGS[best[i]]), confs.append(float(post[i, best[i]])), labels.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(labels, pa.string()), pa.array(langs, pa.string()), pa.array(confs, pa.float64())], ["record_id", "line_no", "label", "lang", "confidence"])

    return df.select("doc_id", "label", "text").mapInArrow(run, "record_id long, line_no long, label string, lang string, confidence double")


def book_languages(sentences: DataFrame, model: Model) -> DataFrame:
    """The language of most of a book's sentences, each counted once, with the share of those sentences."""
    per = text_languages(sentences.select("book_id", "sentence_id", "src"), model, "src").dropDuplicates(["sentence_id"])
    votes = per.groupBy("book_id", "lang").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    main = votes.groupBy("book_id").agg(F.max_by(F.struct("lang", "n", "c"), F.struct("n", "c", "lang")).alias("m"), F.sum("n").alias("all"))
    return main.select("book_id", F.col("m.lang").alias("lang"), (F.col("m.c") / F.col("all")).alias("confidence"))


def languages(sentences: DataFrame, books: DataFrame, documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Every book, document and foreign line: record_kind, record_id, line_no, label, lang, confidence, wrong."""
    model = model or fit(sentences, books)
    b = book_languages(sentences, model).join(books.select("book_id", "language"), "book_id")
    b = b.select(F.lit("book").alias("record_kind"), F.col("book_id").alias("record_id"), F.lit(0).cast("long").alias("line_no"), F.col("language").alias("label"), "lang", "confidence")
    d = document_languages(documents.select("doc_id", F.col("lang").alias("label"), "text"), model)
    d = d.select(F.when(F.col("line_no") == 0, "document").otherwise("segment").alias("record_kind"), "record_id", "line_no", "label", "lang", "confidence")
    all_ = b.unionByName(d)
    wrong = F.col("lang").isNotNull() & ((F.col("record_kind") == "segment") | ~F.coalesce(tag_language(F.col("label")) == F.col("lang"), F.lit(False)))
    return all_.withColumn("wrong", wrong)

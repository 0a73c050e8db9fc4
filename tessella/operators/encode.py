"""Embedding alignment with a pluggable encoder: words to vectors, similarities, pairs, glue, chunks and the gate.

An encoder maps a list of words to a matrix of vectors; it is loaded once a worker. Pairs of texts go through in sub-batches of
similar length, and come back whatever the order. Defined results: blank words are left out and keep their numbers; an item whose
encoder fails has null pairs and goes to the fallback; texts without words have no pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.quality import content_q

Encoder = Callable[[list[str]], np.ndarray]
PAIRS = "array<struct<s:int,t:int>>"


def hashed_encoder(size: int = 128, grams: tuple[int, ...] = (1, 2, 3)) -> Encoder:
    """A deterministic stand-in for a model: counts of hashed character n-grams of the word with its ends marked."""
    import xxhash

    def encode(words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), size))
        for i, w in enumerate(words):
            w = f"<{w.lower()}>"
            for n in grams:
                for k in range(len(w) - n + 1):
                    out[i, xxhash.xxh32_intdigest(w[k : k + n]) % size] += 1.0
        return out

    return encode


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows; a row of zeros is like nothing."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit(a) @ unit(b).T


def best_pairs(sim: np.ndarray, rounds: int = 2) -> set[tuple[int, int]]:
    """Each other's best, ties to the lowest number; then the same among the words left free, of positive similarity."""
    out: set[tuple[int, int]] = set()
    rows, cols = np.arange(sim.shape[0]), np.arange(sim.shape[1])
    for r in range(rounds):
        if not len(rows) or not len(cols):
            break
        part = sim[np.ix_(rows, cols)]
        right, left = part.argmax(1), part.argmax(0)
        new = {(int(rows[i]), int(cols[j])) for i, j in enumerate(right) if left[j] == i and (r == 0 or part[i, j] > 0)}
        out |= new
        rows = np.array([i for i in rows if i not in {p[0] for p in new}], int)
        cols = np.array([j for j in cols if j not in {p[1] for p in new}], int)
    return out


def glue_pairs(sim: np.ndarray, pairs: set[tuple[int, int]], least: float = 0.3, reach: int = 3) -> set[tuple[int, int]]:
    """Free words of either side to their best one of the other, if a word within ``reach`` has it and the similarity suffices."""
    out: set[tuple[int, int]] = set()
    for turn in (False, True):
        m = sim.T if turn else sim
        own = {(j, i) if turn else (i, j) for i, j in pairs}
        taken = {i for i, _ in own}
        for i in range(m.shape[0] if m.size else 0):
            j = int(m[i].argmax())
            if i not in taken and m[i, j] >= least and any(b == j and 1 <= abs(a - i) <= reach for a, b in own):
                out.add((j, i) if turn else (i, j))
    return out


def unit_pairs(pairs: set[tuple[int, int]], units: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """All words of a unit [s, e) with all words that any of them has; none where those are none or more than max(3, 2 x length)."""
    out: set[tuple[int, int]] = set()
    for s, e in units:
        targets = {t for a, t in pairs if s <= a < e}
        if targets and len(targets) <= max(3, 2 * (e - s)):
            out |= {(a, t) for a in range(s, e) for t in targets}
    return out


def align_words(encode: Encoder, src: list[str], tgt: list[str], units=(), least: float = 0.3) -> list[tuple[int, int]]:
    """Distinct sorted pairs (source word, target word) of one pair of texts."""
    a, b = ([i for i, w in enumerate(ws) if w.strip()] for ws in (src, tgt))
    if not a or not b:
        return []
    sim = similarity(encode([src[i] for i in a]), encode([tgt[j] for j in b]))
    pairs = best_pairs(sim)
    pairs |= glue_pairs(sim, pairs, least)
    back = {(a[i], b[j]) for i, j in pairs}
    return sorted(back | unit_pairs(back, list(units)))


def embed_pairs(df: DataFrame, make: Callable[[], Encoder], keys: list[str], batch: int = 32) -> DataFrame:
    """df: keys, src_words, tgt_words (arrays of strings), units (array of (s, e), optional). keys and pairs, null where the encoder
    failed. Rows of a task go in sub-batches sorted by length, so that a padded encoder wastes little."""
    names = [*keys, "src_words", "tgt_words"] + (["units"] if "units" in df.columns else [])
    schema = df.select(*keys, F.lit(None).cast(PAIRS).alias("pairs")).schema

    def run(frames):
        import pandas as pd

        encode = make()
        for f in frames:
            order = (f["src_words"].map(len) + f["tgt_words"].map(len)).argsort(kind="stable").to_numpy()
            out: list = [None] * len(f)
            for k in range(0, len(order), batch):
                for i in order[k : k + batch]:
                    r = f.iloc[i]
                    try:
                        units = [(u["s"], u["e"]) for u in r["units"]] if "units" in f and r["units"] is not None else []
                        out[i] = [{"s": s, "t": t} for s, t in align_words(encode, list(r["src_words"]), list(r["tgt_words"]), units)]
                    except Exception:  # noqa: BLE001 a failed item is the fallback's
                        out[i] = None
            yield pd.DataFrame({c: f[c] for c in keys} | {"pairs": out})

    return df.select(*names).mapInPandas(run, schema)


def chunked(pairs: Column, tgt: Column) -> Column:
    """Column: pairs (source, target) and the target words' offsets to chunks, one a target word, source words distinct and sorted; words
    out of range and negative numbers go."""
    ok = F.filter(pairs, lambda p: (p["s"] >= 0) & (p["t"] >= 0) & (p["t"] < F.size(tgt)))
    ts = F.array_sort(F.array_distinct(F.transform(ok, lambda p: p["t"])))
    word = lambda t: F.try_element_at(tgt, t + 1)
    own = lambda t: F.array_sort(F.array_distinct(F.transform(F.filter(ok, lambda p: p["t"] == t), lambda p: p["s"])))
    return F.transform(ts, lambda t: F.struct(word(t)["s"].alias("t0"), word(t)["e"].alias("t1"), own(t).alias("w")))


def embed_align(df: DataFrame, make: Callable[[], Encoder], keys: list[str], least: float = 0.7, flagged: DataFrame | None = None) -> DataFrame:
    """df: keys, target, src, words (offsets), text. Adds align, q and accepted: alignments of which the content coverage falls short of
    ``least``, that the lexicon flags (flagged: keys), or that failed are the fallback's."""
    x = df.withColumn("_tw", T.offsets(F.coalesce("text", F.lit(""))))
    asked = x.select(*keys, T.word_strings("src", "words").alias("src_words"), T.word_strings("text", "_tw").alias("tgt_words"), *(["units"] if "units" in df.columns else []))
    y = x.join(embed_pairs(asked, make, keys), keys).withColumn("align", F.when(F.col("pairs").isNotNull(), chunked(F.col("pairs"), F.col("_tw"))))
    y = content_q(y).withColumn("q", F.when(F.size("_tw") > 0, F.size("align") / F.size("_tw")).otherwise(F.lit(0.0)))
    if flagged is not None:
        y = y.join(flagged.select(*keys).withColumn("_f", F.lit(True)), keys, "left")
    bad = F.col("align").isNull() | (F.col("q_content") < least) | (F.coalesce("_f", F.lit(False)) if flagged is not None else F.lit(False))
    return y.select(*df.columns, "align", "q", "q_content", (~bad).alias("accepted"))

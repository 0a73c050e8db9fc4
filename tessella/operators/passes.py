"""Passes of pluggable providers over what is pending: batches, retry rounds, reply decoding, keys, provenance, quotes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.align import locate, resolve_echo
from tessella.operators.corpus import pending
from tessella.session import cut

#: A provider maps the batch's [{"id", "src"}] to {id: text}; it may leave ids out.
Provider = Callable[[list[dict]], dict]


def tagging_provider(target: str) -> Provider:
    """A deterministic stand-in for a model: the source with the target in front."""
    return lambda items: {x["id"]: f"[{target}] {x['src']}" for x in items}


def model_component(base: str, glossary_hash: str = "", repaired: bool = False, context: int = 0) -> str:
    """The part of a key that names the model: glossary, proofreading and context mark it."""
    return base + (f"+g:{glossary_hash}" if glossary_hash else "") + ("+rp" if repaired else "") + (f":c{context}" if repaired and context else "")


def glossary_hash(entries: list[tuple[str, str]]) -> str:
    return hashlib.sha256("".join(f"{s}={t}\n" for s, t in entries).encode()).digest()[:6].hex() if entries else ""


def run_pass(todo: DataFrame, provider: Provider, batch: int = 16) -> DataFrame:
    """todo: key, src. Rows key, text of the answers that are neither blank nor artefacts. Batches have short ids of their own."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                got = provider([{"id": str(k + 1), "src": s} for k, s in enumerate(part["src"])])
                rows += [(part["key"].iloc[int(k) - 1], t) for k, t in got.items() if k.isdigit() and 0 < int(k) <= len(part) and isinstance(t, str)]
            yield pd.DataFrame(rows, columns=["key", "text"])

    out = todo.select("key", "src").mapInPandas(run, "key string, text string")
    return out.where((F.trim("text") != "") & ~T.is_artifact("text"))


def run_rounds(wanted: DataFrame, store: DataFrame, provider: Provider, rounds: int = 3, batch: int = 16) -> DataFrame:
    """wanted: key, src. store: key, text. The store with all that the provider gives in at most ``rounds`` rounds; each round
    asks only for what is still missing, and each round's result is cut off its lineage."""
    store = store.select("key", "text")
    for _ in range(rounds):
        todo = cut(pending(wanted, store))
        if todo.isEmpty():
            break
        got = run_pass(todo, provider, batch)
        store = cut(store.join(todo.select("key"), "key", "left_anti").unionByName(got))
    return store


def invalidated(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key"), "key", "left_anti")


def decode_reply(content: str | None) -> dict | None:
    """The object in a model's reply: thinking and fences dropped, then the outermost braces. None where there is none."""
    s = re.sub(r"(?s)^\s*<think>.*?</think>", "", content or "")
    if s.lstrip().startswith("<think>"):
        return None
    for part in (s, re.sub(r"(?s)^\s*```\w*\s*|\s*```\s*$", "", s), s[s.find("{") : s.rfind("}") + 1]):
        try:
            out = json.loads(part)
        except ValueError:
            continue
        if isinstance(out, dict):
            return out
    return None


def echo_words(en) -> list[str]:
    """The words of an echo: a string's, or those of the strings in a list; anything else has none."""
    if isinstance(en, str):
        return en.split()
    return [w for x in en if isinstance(x, str) for w in x.split()] if isinstance(en, list) else []


def decode_verdicts(content: str) -> dict[str, dict]:
    """Verdicts by id, from an object of them or a list of ones with ids, numeric or not."""
    try:
        x = json.loads(content)
    except ValueError:
        return {}
    if isinstance(x, dict):
        x = x.get("verdicts", x)
    if isinstance(x, dict):
        return {str(k): v for k, v in x.items() if isinstance(v, dict)}
    return {str(v["id"]): {k: y for k, y in v.items() if k != "id"} for v in x if isinstance(v, dict) and "id" in v} if isinstance(x, list) else {}


def append_run(meta: dict, run: dict, most: int = 20) -> dict:
    """Provenance: the first run sets the creation stamp, later ones the update stamp. A run equal to the last but for its time
    leaves the last as it is; the newest ``most`` stay. Other keys of the record stay."""
    same = lambda r: {k: v for k, v in r.items() if k != "at"}
    stamp = {"createdAt": run["at"]} if meta.get("createdAt") in (None, "") else {"updatedAt": run["at"]}
    runs = list(meta.get("runs") or [])
    if not runs or same(runs[-1]) != same(run):
        runs = [*runs, run][-most:]
    return meta | stamp | {"runs": runs}


def phase(final: Column, raw: Column, proofread: Column) -> Column:
    """The pass a source waits for, by the keyed texts it has: what is an artefact counts as missing, final first."""
    good = lambda c: c.isNotNull() & ~T.is_artifact(c)
    return F.when(good(final), "done").when(~good(raw), "translate").when(proofread.isNull(), "proofread").otherwise("align")


def frozen(raw: DataFrame, proofread: DataFrame) -> DataFrame:
    """key, text: the proofread text, else the raw one, so that nothing waits for ever for a proofreader that gave none."""
    both = raw.select("key", F.col("text").alias("_r")).join(proofread.select("key", F.col("text").alias("_p")), "key", "left")
    return both.where(F.trim(F.coalesce("_p", "_r", F.lit(""))) != "").select("key", F.coalesce("_p", "_r").alias("text"))


def _asked(df: DataFrame, provider: Callable, columns: list[str], schema: str, read: Callable, batch: int) -> DataFrame:
    """Batches of rows under short ids of their own through a provider; ``read`` makes the rows of one answer. Answers to ids that
    were not asked for are dropped; a batch whose provider fails gives nothing and is asked again in the next round."""

    def run(frames):
        import pandas as pd

        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        for f in frames:
            rows = []
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch].to_dict("records")
                try:
                    got = provider([{"id": str(k + 1)} | {c: r[c] for c in columns} for k, r in enumerate(part)])
                except Exception:  # noqa: BLE001, S112 a failed batch is left for the next round
                    continue
                for k, answer in got.items():
                    if str(k).strip().isdigit() and 0 < int(k) <= len(part):
                        rows += read(part[int(k) - 1], answer)
            yield pd.DataFrame(rows, columns=names)

    return df.select("key", *columns).mapInPandas(run, schema)


def run_proofread(todo: DataFrame, provider: Callable, batch: int = 16) -> DataFrame:
    """todo: key, src, text, context (array of src and tr, may be empty). key, text: proofread, neither blank nor artefacts."""
    out = _asked(todo, provider, ["src", "text", "context"], "key string, text string", lambda r, x: [(r["key"], x)] if isinstance(x, str) else [], batch)
    return out.where((F.trim("text") != "") & ~T.is_artifact("text"))


def run_align(todo: DataFrame, provider: Callable, batch: int = 4) -> DataFrame:
    """todo: key, src, words (offsets), text. key, align, q: fragments located in the text in turn, echoed source words resolved to
    numbers; an answer of which a mapped fragment can't be located is dropped. q is the share of the text's runs of letters and
    digits that a mapped fragment meets."""

    def read(r, answer):
        words = [r["src"][w["s"] : w["e"]] for w in r["words"]]
        found = [(c.get("tgt"), echo_words(c.get("src"))) for c in answer if isinstance(c, dict)] if isinstance(answer, list) else []
        places = locate([t for t, _ in found], r["text"])
        align = []
        for (t, echo), at in zip(found, places):
            w = sorted(set(resolve_echo(echo, words)))
            if at is None and w and any(c.isalnum() for c in t or ""):
                return []
            if at is not None and w:
                align.append({"t0": at[0], "t1": at[1], "w": w})
        runs = [m.span() for m in re.finditer(r"[^\W_]+", r["text"])]
        q = sum(any(c["t0"] < e and s < c["t1"] for c in align) for s, e in runs) / len(runs) if runs else 0.0
        return [(r["key"], align, round(q + 1e-9, 2))]

    return _asked(todo, provider, ["src", "words", "text"], "key string, align array<struct<t0:int,t1:int,w:array<int>>>, q double", read, batch)


def run_judge(todo: DataFrame, provider: Callable, batch: int = 16) -> DataFrame:
    """todo: key, src, text, pairs. key, ok, why; what the provider leaves out stays unjudged."""
    read = lambda r, v: [(r["key"], bool(v.get("ok")), str(v.get("why") or "") or None)] if isinstance(v, dict) else []
    return _asked(todo, provider, ["src", "text", "pairs"], "key string, ok boolean, why string", read, batch)


def glossary(sample: DataFrame, provider: Callable[[list[str]], list[dict]]) -> DataFrame:
    """sample: src, at most a few hundred rows. src, tgt of the terms of one call to the provider: trimmed, without blank ones, each
    source once, sorted."""
    got = provider([r.src for r in sample.collect()])
    terms = {s: t for x in got if (s := str(x.get("src") or "").strip()) and (t := str(x.get("tgt") or "").strip())}
    return sample.sparkSession.createDataFrame(sorted(terms.items()), "src string, tgt string")


def glossary_file(scope: dict, terms: list[dict]) -> str:
    """The editable glossary: its scope (source, target, title, author, sentences) and its terms."""
    return json.dumps(scope | {"terms": terms}, ensure_ascii=False, indent=2)


def read_glossary(text: str, scope: dict) -> list[dict]:
    """The terms of a glossary file, blank ones dropped; a file of another scope is an error."""
    got = json.loads(text)
    if {k: got.get(k) for k in scope} != scope:
        raise ValueError("the glossary is of another book or language pair")
    clean = [{k: str(t.get(k) or "").strip() for k in ("src", "tgt")} for t in got.get("terms") or []]
    return [t for t in clean if t["src"] and t["tgt"]]


def escalated(flagged: DataFrame, redo: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """flagged: key, src, text. Flagged answers are made again and verified, at most ``rounds`` times; of what stays flagged the
    alignment goes (``stripped``). redo: key, src, text to key, text. verify: key, src, text to key, ok."""
    left, done = flagged.select("key", "src", "text"), None
    for _ in range(rounds):
        new = left.select("key", "src", F.col("text").alias("_old")).join(redo(left), "key", "left").select("key", "src", F.coalesce("text", "_old").alias("text"))
        checked = cut(new.join(verify(new), "key", "left"))
        good = checked.where("ok").select("key", "text", F.lit(False).alias("stripped"))
        done = good if done is None else done.unionByName(good)
        left = checked.where("not coalesce(ok, false)").select("key", "src", "text")
        if left.isEmpty():
            break
    rest = left.select("key", "text", F.lit(True).alias("stripped"))
    return rest if done is None else done.unionByName(rest)


# --- stand-ins for models, deterministic
def echoing_aligner() -> Callable:
    """Maps each source word to itself in the text, as 'number:word'."""
    return lambda items: {x["id"]: [{"tgt": x["src"][w["s"] : w["e"]], "src": f"{i}:{x['src'][w['s'] : w['e']]}"} for i, w in enumerate(x["words"])] for x in items}


def length_judge(least: float = 1 / 3) -> Callable:
    """Finds fault with texts much shorter than their source."""
    return lambda items: {x["id"]: {"ok": len(x["text"]) >= least * len(x["src"]), "why": "" if len(x["text"]) >= least * len(x["src"]) else "too short"} for x in items}


def long_words_glossary(target: str, least: int = 8) -> Callable:
    """Takes long words for terms."""
    return lambda sources: [{"src": w, "tgt": f"[{target}] {w}"} for s in sources for w in T.plain_words(s) if len(w) >= least]


_QUOTES = (("“", "”"), ("„", "“"), ("«", "»"), ('"', '"'))


def split_quoted(text: str, segment: Callable[[str], list[str]], depth: int = 3) -> list[str]:
    """Splits again what a segmenter left whole because of quotes: inside a quote that holds sentences, and behind one whose
    interior ends a sentence when a capital follows."""
    cuts = set()
    for a, b in _QUOTES:
        for m in re.finditer(re.escape(a) + r"[^" + re.escape(a + b) + r"]*" + re.escape(b), text):
            inner = text[m.start() + 1 : m.end() - 1]
            at = 0
            for piece in segment(inner)[:-1] if depth else []:
                at = inner.index(piece, at) + len(piece)
                cuts.add(m.start() + 1 + at)
            if re.search(r"[.!?…]$", inner) and re.match(r"\s+[\"“«„]?[A-ZÀ-ÞА-ЯЁ]", text[m.end() :]):
                cuts.add(m.end())
    places = sorted(c for c in cuts if 0 < c < len(text))
    out = [text[s:e].strip() for s, e in zip([0, *places], [*places, len(text)])]
    return [p for p in out if p]

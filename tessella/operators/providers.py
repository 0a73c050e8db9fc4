"""What surrounds a provider of model answers: prompts, retries with back-off, classes of errors, provenance of a run."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from tessella.functions.text import LANG_NAMES, PERMANENT

# --- prompts, in our own words
_PROMPTS = {
    "translate": "You translate books from {SRC} to {TGT}. For every item give the translation of its src under its id, as one JSON object; keep names, numbers and tone.",
    "proofread": "You proofread translations from {SRC} to {TGT}. For every item give the corrected tr under its id, unchanged where it is sound; prev is context and is not to be answered.",
    "align": "You align translations with their {SRC} source. For every item give under its id a list of fragments of tr in order, each with the numbered source words it renders.",
    "judge": "You check translations from {SRC} to {TGT} with their word pairs. For every item give under its id ok, true or false, and if false why in a few words.",
    "glossary": "You collect recurring terms and names of a book. Give as JSON a glossary of src in {SRC} and tgt in {TGT}.",
}


def prompt(kind: str, source: str, target: str, glossary: list[dict] = ()) -> str:
    """The instructions of a pass for a pair of languages, with the terms to keep to."""
    name = lambda c: LANG_NAMES.get(c, c)
    text = _PROMPTS[kind].replace("{SRC}", name(source)).replace("{TGT}", name(target))
    terms = [f"- {t['src']} = {t['tgt']}" for t in glossary]
    return "\n".join([text, "Always use these terms:", *terms]) if terms and kind in ("translate", "proofread") else text


class Failed(Exception):
    """A provider's failure: its status, and the seconds after which it asks to be asked again."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


class Exhausted(Exception):
    """A used-up quota: the run ends, and goes on from its store later."""


def backoff(attempt: int, retry_after: float | None = None, jitter: Callable[[], float] = random.random) -> float:
    """Seconds before attempt + 1: what the provider asks for, else 1, 2, 4, … at most 30, and up to half a second more."""
    return retry_after if retry_after is not None else min(30.0, 2.0**attempt) + 0.5 * jitter()


def with_retries(ask: Callable, retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """A provider that is asked again when it fails, unless nothing would mend it. Exhausted quotas end at once."""

    def run(items):
        for attempt in range(retries + 1):
            try:
                return ask(items)
            except Failed as e:
                if e.status in PERMANENT or attempt == retries:
                    raise
                sleep(backoff(attempt, e.retry_after))
        return {}

    return run


def ends_run(error: Exception) -> bool:
    """Whether an error ends the run: quotas and permanent failures do, others leave their batch for the next round."""
    return isinstance(error, Exhausted) or isinstance(error, Failed) and error.status in PERMANENT


def without_secrets(env: dict[str, str]) -> dict[str, str]:
    """An environment without what may be a credential."""
    hidden = ("KEY", "TOKEN", "SECRET", "PASSWORD", "CREDENTIAL")
    return {k: v for k, v in env.items() if not any(h in k.upper() for h in hidden)}


# --- fixed values: what a record of provenance may hold of the options
RECORDED = ("batch", "rounds", "context", "align", "glossary", "lexicon", "skip_citations", "limit_chapters")


def provenance(at: str, producer: str, provider: str, passes: dict[str, tuple[str, str] | None], options: dict) -> dict:
    """A run's record: model and contract version of the passes that ran, and options of the list that are set; no paths, hosts or keys."""
    ran = {k: {"model": v[0], "version": v[1]} for k, v in passes.items() if v}
    kept = {k: options[k] for k in RECORDED if options.get(k) is not None}
    return {"at": at, "producer": producer, "provider": provider, "passes": ran} | ({"options": kept} if kept else {})


def merged_meta(extra: dict, known: dict) -> dict:
    """Unknown keys of a record stay; registered ones win."""
    return {**{k: v for k, v in extra.items() if k not in known}, **known}

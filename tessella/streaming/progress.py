"""Progress events: at most one line per key and half second, final ones always, exact repeats never."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

EVERY_MS = 500
SCHEMA = "phase string, target string, ts timestamp, done bigint, total bigint, final boolean"


def keep(rows, last: tuple[int, int, int] | None = None, every_ms: int = EVERY_MS):
    """rows: (ms, done, total, final) in time order. The kept ones and the last written (ms, done, total). A repeat of the last
    (done, total) goes first, then the throttle applies unless the row is final, by its mark or by done >= total > 0."""
    out = []
    for i, (ms, done, total, final) in enumerate(rows):
        if last and (done, total) == last[1:]:
            continue
        if last and ms - last[0] < every_ms and not (final or done >= total > 0):
            continue
        out.append(i)
        last = (ms, done, total)
    return out, last


def _rows(pdf: pd.DataFrame):
    ms = pdf["ts"].astype("datetime64[us]").astype("int64") // 1000
    return list(zip(ms.tolist(), pdf["done"].tolist(), pdf["total"].tolist(), pdf["final"].tolist()))


def throttle(events: DataFrame) -> DataFrame:
    """Batch form, a fold over each key's events in time order, batch by batch: of a key's events only the last written line is
    held. Keys are phase and target; null ones are keys too."""

    def run(frames):
        key, last = None, None
        for f in frames:
            rows, kept = _rows(f), []
            names = list(zip(f["phase"], f["target"]))
            for i, name in enumerate(names):
                if name != key:
                    key, last = name, None
                got, last = keep([rows[i]], last)
                if got:
                    kept.append(i)
            yield f.iloc[kept]

    cols = ["phase", "target", "ts", "done", "total", "final"]
    return events.select(*cols).repartition("phase", "target").sortWithinPartitions("phase", "target", "ts", "done").mapInPandas(run, SCHEMA)


def throttle_stream(events: DataFrame) -> DataFrame:
    """Streaming form: the last written line of each key is the state."""

    def run(key, frames, state):
        last = state.get if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "done"], kind="stable").reset_index(drop=True)
            kept, last = keep(_rows(pdf), tuple(last) if last else None)
            yield pdf.iloc[kept]
        if last:
            state.update(tuple(last))

    return events.select("phase", "target", "ts", "done", "total", "final").groupBy("phase", "target").applyInPandasWithState(run, SCHEMA, "ms bigint, done bigint, total bigint", "append", "NoTimeout")

"""Streams with a state of their own per key: a running median, and chapters opened by a mark.

Both take rows with an event time.  Rows behind the watermark are late and drop
out, as in any stream with one; a key that is silent for ``idle`` is closed and its
state goes.  All state lives in the checkpoint, so a restarted stream goes on
where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _millis(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def running_median(rows: DataFrame, key: str, value: str, time: str = "ts", late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """key, n, median, closed: the exact median of a key's values so far, after each batch that has some.

    Update mode.  A key silent for ``idle`` has a last row, closed; values that come
    later start it anew.  The state is the key's distinct values with their counts;
    nulls and NaN are not counted.
    """
    wait = _millis(idle)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # a call for a timeout has no rows and no key, so the state keeps it
        name, values, counts, last = state.get if state.exists else (k[0], [], [], 0)
        held = dict(zip(values, counts))
        if state.hasTimedOut:
            state.remove()
            yield _median_row(key, name, held, True)
            return
        for p in parts:
            for v, c in p["value"].dropna().value_counts().items():
                held[float(v)] = held.get(float(v), 0) + int(c)
            last = max(last, int(p["at"].max()))
        ordered = sorted(held)
        state.update((name, ordered, [held[v] for v in ordered], last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        if held:
            yield _median_row(key, name, held, False)

    kind = rows.schema[key].dataType.simpleString()
    picked = rows.withWatermark(time, late).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.unix_millis(time).alias("at"), time)
    out = picked.groupBy("key").applyInPandasWithState(step, f"`{key}` {kind}, n long, median double, closed boolean", f"name {kind}, values array<double>, counts array<long>, last long", "update", "EventTimeTimeout")
    return out


def _median_row(column: str, key, held: dict[float, int], closed: bool) -> pd.DataFrame:
    ordered = np.array(sorted(held))
    ends = np.cumsum([held[v] for v in ordered])
    n = int(ends[-1]) if len(ends) else 0
    middle = [float(ordered[np.searchsorted(ends, i, side="right")]) for i in ((n - 1) // 2, n // 2)] if n else [None]
    return pd.DataFrame([(key, n, sum(middle) / 2 if n else None, closed)], columns=[column, "n", "median", "closed"])


def chapters(cues: DataFrame, key: str, mark: str = "mark", order: str = "idx", time: str = "ts", late: str = "10 minutes", idle: str = "1 hour") -> DataFrame:
    """key, chapter, first_idx, last_idx, n_cues of every chapter that has ended.

    A mark opens a chapter, but for a key's first cue.  Cues wait until the
    watermark has passed them and are then taken by time and order, so those that
    come out of turn, but not late, stand where they belong.  A chapter ends with
    the next one's mark, or when its key is silent for ``idle``.  Append mode.
    The state holds the cues that wait and the open chapter.
    """
    wait = _millis(idle)
    empty = ([], [], [], 0, None, None, 0, 0)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        name, at, places, marks, chapter, first, last, n, seen = state.get if state.exists else (k[0], *empty)
        waiting = list(zip(at, places, marks))
        if not state.hasTimedOut:
            for p in parts:
                waiting += zip(p["at"].astype(int).tolist(), p["place"].astype(int).tolist(), p["mark"].fillna(False).astype(bool).tolist())
        now = state.getCurrentWatermarkMs()
        waiting.sort()
        done = []
        while waiting and waiting[0][0] < now:
            t, place, is_mark = waiting.pop(0)
            if is_mark and n:
                done.append((name, chapter, first, last, n))
                chapter, first, n = chapter + 1, None, 0
            first, last = place if first is None else min(first, place), place if n == 0 else max(last, place)
            n, seen = n + 1, t
        if not waiting and n and seen + wait < now:
            done.append((name, chapter, first, last, n))
            state.remove()
        else:
            state.update((name, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting], chapter, first, last, n, seen))
            state.setTimeoutTimestamp(max(waiting[0][0] if waiting else seen + wait, now) + 1)
        if done:
            yield pd.DataFrame(done, columns=[key, "chapter", "first_idx", "last_idx", "n_cues"])

    kind = cues.schema[key].dataType.simpleString()
    picked = cues.withWatermark(time, late).select(F.col(key).alias("key"), F.unix_millis(time).alias("at"), F.col(order).cast("long").alias("place"), F.col(mark).cast("boolean").alias("mark"), time)
    return picked.groupBy("key").applyInPandasWithState(
        step, f"`{key}` {kind}, chapter long, first_idx long, last_idx long, n_cues long",
        f"name {kind}, at array<long>, places array<long>, marks array<boolean>, chapter long, first long, last long, n long, seen long", "append", "EventTimeTimeout",
    )

"""Micro-batching of requests: in batch form, and as a stream whose groups are flushed when full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import length_bucket


def group_requests(requests: DataFrame, order: str, group: list[str], texts: str) -> DataFrame:
    """``requests`` with ``offset``: where each one's texts begin within its group's batch."""
    before = F.sum(texts).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return requests.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))


OUTPUT = "req_id long, options string, bucket int, batch long, offset long, n int, error string"
STATE = "batch long, since long, ids array<long>, sizes array<int>"


def flush_full(requests: DataFrame, batch_size: int = 12, window_ms: int = 0) -> DataFrame:
    """A streaming (or batch) table of requests (req_id, options, texts) to rows of OUTPUT, a row a request.

    Requests with the same options and length bucket wait together until they have ``batch_size`` texts; then they are
    one batch. A request is never split, so a batch may be larger. With ``window_ms`` those too few for a batch wait
    across triggers until others come or the first of them has waited so long; without, what waits when a trigger's
    rows have been seen is flushed at its end, as a free worker would. A null list of texts is an error of that
    request alone. What waits is fewer than ``batch_size`` texts a group. While something waits a trigger that takes
    what is available and stops doesn't stop, as its timer is still to come.
    """
    if batch_size < 1 or window_ms < 0:
        raise ValueError("batch_size must be positive, window_ms not negative")
    longest = F.coalesce(F.array_max(F.transform("texts", lambda t: F.char_length(t))), F.lit(0))
    own = requests.select("req_id", "options", length_bucket(longest).alias("bucket"), F.when(F.col("texts").isNotNull(), F.size("texts")).alias("n"))
    columns = [x.split()[0] for x in OUTPUT.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, since, ids, sizes = state.get if state.exists else (0, 0, [], [])
        waiting = list(zip(ids, sizes))
        now = state.getCurrentProcessingTimeMs() if window_ms else 0

        def flushed() -> list[tuple]:
            nonlocal batch, waiting
            offsets = [sum(n for _, n in waiting[:i]) for i in range(len(waiting))]
            out = [(r, *key, batch, at, n, None) for (r, n), at in zip(waiting, offsets)]
            batch, waiting = batch + bool(waiting), []
            return out

        if state.hasTimedOut:
            yield pd.DataFrame(flushed(), columns=columns)
        for frame in frames:
            out = []
            for req_id, n in frame.sort_values("req_id")[["req_id", "n"]].itertuples(index=False):
                if pd.isna(n):
                    out.append((req_id, *key, -1, 0, 0, "texts is null"))
                    continue
                since = since if waiting else now
                waiting.append((int(req_id), int(n)))
                if sum(x for _, x in waiting) >= batch_size:
                    out += flushed()
            yield pd.DataFrame(out, columns=columns)
        if waiting and (not window_ms or now - since >= window_ms):
            yield pd.DataFrame(flushed(), columns=columns)
        state.update((batch, since, [r for r, _ in waiting], [n for _, n in waiting]))
        if waiting:
            state.setTimeoutDuration(max(1, since + window_ms - now))

    return own.groupBy("options", "bucket").applyInPandasWithState(run, OUTPUT, STATE, "append", "ProcessingTimeTimeout" if window_ms else "NoTimeout")

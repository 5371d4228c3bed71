"""Structured Streaming forms of the rank mean and of the late-leaving top set.

rank_ema is keyed by entity: its state is one mean, so it spreads over the cluster. The top set needs a date's whole
cross-section: it is keyed by stream (fold or candidate), its state is the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.recursion import select_top


def rank_ema(stream: DataFrame, alpha: float) -> DataFrame:
    """stream: entity, dt, rank, complete dates in order. Adds smoothed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        pdf = pd.concat(batches).sort_values("dt")
        out = []
        for r in pdf["rank"]:
            mean = r if mean is None else alpha * r + (1 - alpha) * mean
            out.append(mean)
        state.update((mean,))
        yield pdf.assign(smoothed=out)[["entity", "dt", "rank", "smoothed"]]

    kinds = dict(stream.dtypes)
    return stream.select("entity", "dt", "rank").groupBy("entity").applyInPandasWithState(run, f"entity {kinds['entity']}, dt {kinds['dt']}, rank double, smoothed double", "mean double", "append", GroupStateTimeout.NoTimeout)


def hysteresis(stream: DataFrame, exit_fraction: float, denominator: int = 10, min_pool: int = 100) -> DataFrame:
    """stream: series, entity, dt, smoothed, flag_limit_up, complete dates in order. Adds final."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(state.get[0]) if state.exists else set()
        pdf = pd.concat(batches).sort_values(["dt", "smoothed", "entity"], ascending=[True, False, True])
        for _, day in pdf.groupby("dt", sort=True):
            _, final, before = select_top(day["entity"].tolist(), (day["flag_limit_up"] == 0).tolist(), before, exit_fraction, denominator, min_pool)
            yield day.assign(final=final)[["series", "entity", "dt", "final"]]
        state.update((list(before),))

    kinds = dict(stream.dtypes)
    return stream.groupBy("series").applyInPandasWithState(run, f"series {kinds['series']}, entity {kinds['entity']}, dt {kinds['dt']}, final double", f"members array<{kinds['entity']}>", "append", GroupStateTimeout.NoTimeout)

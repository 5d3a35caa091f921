"""EWMA variance as a stateful stream (an addition): one state row for each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "symbol string, date timestamp, ret double, sigma2 double"


def ewma(returns: DataFrame, decay: float = 0.94, start: float = 0.0) -> DataFrame:
    """(symbol, date, ret, sigma2): each day's forecast from the days before it.

    State is (variance of the next day, last day seen); rows that come late, for a
    day not after the last, are left out, as their forecasts were made.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        variance, last = state.get if state.exists else (start, 0)
        pdf = pd.concat(list(frames)).sort_values("date")
        out = []
        for day, ret in zip(pdf["date"], pdf["ret"], strict=True):
            at = int(pd.Timestamp(day).value)
            if at <= last and state.exists:
                continue
            out.append((key[0], day, float(ret), variance))
            variance, last = decay * variance + (1 - decay) * float(ret) ** 2, at
        state.update((variance, last))
        yield pd.DataFrame(out, columns=["symbol", "date", "ret", "sigma2"])

    return returns.groupBy("symbol").applyInPandasWithState(step, OUT, "variance double, last bigint", "append", GroupStateTimeout.NoTimeout)

"""Rolling covariance of many symbols: average correlation and the share of
the first eigenvalue."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.factors import with_ranks

POWER_ROUNDS = 50


def first_share(cov: np.ndarray, rounds: int = POWER_ROUNDS) -> float | None:
    """The largest eigenvalue, by power iteration from an even start, over the trace."""
    trace = float(np.trace(cov))
    if not trace > 0:
        return None
    v = np.full(len(cov), len(cov) ** -0.5)
    for _ in range(rounds):
        v = cov @ v
        norm = np.linalg.norm(v)
        if norm == 0:
            return 0.0
        v = v / norm
    return float(v @ cov @ v) / trace


def _window(x: np.ndarray, least: int) -> tuple:
    """(symbols, average correlation, share, mean size) of a window's returns,
    moments × symbols in the symbols' order, nan where there is none."""
    x = x[:, (~np.isnan(x)).sum(axis=0) >= least]
    if x.shape[1] < 2:
        return x.shape[1], None, None, None
    known = ~np.isnan(x)
    # of a moment that lacks a symbol, those before it in order count in the mean size
    size = np.abs(x[np.logical_and.accumulate(known, axis=1)])
    full = x[known.all(axis=1)]
    mean = float(size.mean()) if len(size) else None
    if len(full) < least:
        return x.shape[1], None, None, mean
    away = full - full.mean(axis=0)
    cov = away.T @ away / max(len(full) - 1, 1)
    scale = np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    pairs = np.triu_indices(len(cov), 1)
    some = scale[pairs] > 0
    corr = float((cov[pairs][some] / scale[pairs][some]).mean()) if some.any() else None
    return x.shape[1], corr, first_share(cov), mean


def _block(symbol: str, at: str, ret: str, window: int, least: int, step: int) -> Callable:
    names = [at, "symbols", "avg_corr", "first_share", "mean_abs_ret"]

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[0]) * step
        order = pdf.drop_duplicates("place").set_index("place")[at]
        wide = pdf[pdf[symbol].notna()].pivot_table(index="place", columns=symbol, values=ret, aggfunc="last", dropna=False, sort=True)
        x = wide.reindex(range(start - window + 1, start + step)).to_numpy(dtype=float)
        out = [(order[p], *_window(x[p - start : p - start + window], least)) for p in range(start, start + step) if p in order.index]
        return pd.DataFrame(out, columns=names)

    return block


def rolling_covariance(returns: DataFrame, symbol: str, at: str, ret: str, window: int = 60, least: int = 20, step: int = 600) -> DataFrame:
    """at, symbols, avg_corr, first_share, mean_abs_ret for every moment that
    any row has, over the last ``window`` such moments.

    A symbol takes part with ``least`` returns in the window; moments in which
    all of these have one make the covariance, if there are ``least`` of them.
    Moments are numbered by slices of their values and cut into blocks of
    ``step``; a block is computed with the ``window - 1`` moments before it, so
    a row goes to at most ``2 + window // step`` blocks and a task holds
    step + window moments of all symbols.  A null return is no return; one row a
    symbol and moment is expected.
    """
    moments = with_ranks(returns.select(at).filter(F.col(at).isNotNull()).distinct(), at, [], None, place="place")
    d = returns.select(F.when(F.col(ret).isNotNull(), F.col(symbol)).alias(symbol), at, F.col(ret).cast("double").alias(ret)).join(moments, at)
    first, last = F.floor(F.col("place") / step), F.floor((F.col("place") + (window - 1)) / step)
    blocks = d.withColumn("block", F.explode(F.sequence(first, last)))
    schema = returns.select(at).schema.add("symbols", "long").add("avg_corr", "double").add("first_share", "double").add("mean_abs_ret", "double")
    return blocks.groupBy("block").applyInPandas(_block(symbol, at, ret, window, least, step), schema)

"""Sparse inverse covariances (graphical lasso) of many groups at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sweeps over all columns, sweeps of one column's regression, and the change at which both stop.
SWEEPS, INNER, SMALL = 500, 1000, 1e-11


def graphical_lasso(s: np.ndarray, penalty: float) -> np.ndarray:
    """Of covariances (groups x p x p): the inverses that maximise log det - trace - penalty * sum of off-diagonal sizes.

    Block coordinate descent: a column's regression on all others, under the present estimate of their covariance, is solved by
    soft thresholds; all groups go at once. Penalty 0 gives the inverse.
    """
    s = np.asarray(s, dtype=np.float64)
    p, w = s.shape[1], s.copy()
    beta = np.zeros((len(s), p, p))  # row j: the regression of j on the others
    for _ in range(SWEEPS):
        before = w.copy()
        for j in range(p):
            rest = [k for k in range(p) if k != j]
            v, t, b = w[:, rest][:, :, rest], s[:, rest, j], beta[:, j][:, rest]
            for _ in range(INNER):
                last = b.copy()
                for k in range(p - 1):
                    r = t[:, k] - np.einsum("gi,gi->g", v[:, k], b) + v[:, k, k] * b[:, k]
                    b[:, k] = np.sign(r) * np.maximum(np.abs(r) - penalty, 0) / v[:, k, k]
                if np.abs(b - last).max(initial=0) < SMALL:
                    break
            beta[:, j, rest] = b
            w[:, rest, j] = w[:, j, rest] = np.einsum("gij,gj->gi", v, b)
        if np.abs(w - before).max(initial=0) < SMALL:
            break
    out = np.zeros_like(w)
    for j in range(p):
        d = 1 / (w[:, j, j] - np.einsum("gi,gi->g", w[:, j], beta[:, j]))
        out[:, j] = -beta[:, j] * d[:, None]
        out[:, j, j] = d
    return (out + out.transpose(0, 2, 1)) / 2


def edges(df: DataFrame, group: str, cols: list[str], penalty: float) -> DataFrame:
    """group, i, j (places in cols, i < j) and partial, the partial correlation of every edge that the penalty leaves, from each group's correlations.

    Only sums move: rows are added up to one row of moments a group, and groups are solved in batches. Rows with a null in
    any of cols play no part; a group where one of them doesn't vary has no edges.
    """
    p = len(cols)
    places = [(i, j) for i in range(p) for j in range(i + 1)]
    full = df.na.drop(subset=cols)
    held = full.groupBy(group).agg(F.array(*[F.covar_pop(cols[i], cols[j]) for i, j in places]).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros((len(batch), p, p))
            for k, (i, j) in enumerate(places):
                s[:, i, j] = s[:, j, i] = np.asarray(batch.column(1).flatten(), dtype=np.float64)[k :: len(places)]
            sd = np.sqrt(np.maximum(np.einsum("gii->gi", s), 0))
            ok = np.flatnonzero((sd > 0).all(axis=1))
            o = graphical_lasso(s[ok] / (sd[ok][:, :, None] * sd[ok][:, None, :]), penalty)
            d = np.sqrt(np.einsum("gii->gi", o))
            part = -o / (d[:, :, None] * d[:, None, :])
            g, i, j = np.nonzero(np.triu(part, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok[g])), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(part[g, i, j])], [group, "i", "j", "partial"])

    return held.mapInArrow(run, f"`{group}` {df.schema[group].dataType.simpleString()}, i int, j int, partial double")

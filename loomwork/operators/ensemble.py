"""Four anomaly scores, their conformal p-values against calibration rows, Fisher's combination and its EWMA."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import scan

#: Reference rows that the scores are fitted on, and calibration rows that they are compared with; both picked by a hash.
REFERENCE, CALIBRATION = 2000, 2000
NEAREST, COMPONENTS = 5, 2
SCORES = ["mahalanobis", "nearest", "residual", "subset"]


@dataclass
class Fitted:
    """What the scores need of the reference rows; everything has the size of that sample at most."""

    mean: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray
    loadings: np.ndarray
    pairs: list[tuple[int, int, np.ndarray]]
    rows: np.ndarray
    calibration: np.ndarray | None = None  # sorted scores of the calibration rows, one row of it for each score

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mahalanobis distance, distance to the NEAREST-th reference row, what the leading components leave, and the largest distance in any two columns."""
        z = (x - self.mean) / self.scale
        far = np.einsum("ni,ij,nj->n", z, self.inverse, z)
        near = np.zeros(len(z))
        for at in range(0, len(z), 512):
            d = ((z[at : at + 512, None] - self.rows[None]) ** 2).sum(axis=2)
            k = min(NEAREST, d.shape[1]) - 1
            near[at : at + 512] = np.sqrt(np.partition(d, k, axis=1)[:, k])
        rest = z - np.einsum("ni,ik,jk->nj", z, self.loadings, self.loadings)
        two = np.stack([np.einsum("ni,ij,nj->n", z[:, [i, j]], v, z[:, [i, j]]) for i, j, v in self.pairs])
        return np.stack([far, near, (rest**2).sum(axis=1), two.max(axis=0)])

    def p_values(self, x: np.ndarray) -> np.ndarray:
        """(1 + calibration scores at least as high) / (n + 1) of each score."""
        n = self.calibration.shape[1]
        return np.stack([(1 + n - np.searchsorted(c, s, side="left")) / (n + 1) for c, s in zip(self.calibration, self.scores(x), strict=True)])


def fit(reference: np.ndarray, calibration: np.ndarray) -> Fitted:
    """A column that doesn't vary has scale 1; covariances get a small ridge, so that dependent columns do no harm."""
    mean, scale = reference.mean(axis=0), reference.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = (reference - mean) / scale
    cov = np.einsum("ni,nj->ij", z, z) / len(z) + 1e-9 * np.eye(z.shape[1])
    w, q = np.linalg.eigh(cov)
    p = z.shape[1]
    pairs = [(i, j, np.linalg.inv(cov[np.ix_([i, j], [i, j])])) for i, j in combinations(range(p), 2)]
    out = Fitted(mean, scale, np.linalg.inv(cov), q[:, np.argsort(-w)[: min(COMPONENTS, p - 1)]], pairs, z)
    out.calibration = np.sort(out.scores(calibration), axis=1)
    return out


def sample(df: DataFrame, cols: list[str], which: Column, keys: list[str], n: int) -> np.ndarray:
    """n rows at most, picked by a hash of their keys."""
    held = df.where(which).orderBy(F.xxhash64(F.lit(3), *keys), *keys).select(*[F.col(c).cast("double") for c in cols]).limit(n).toArrow()
    return np.stack([np.asarray(held.column(c).combine_chunks()) for c in cols], axis=1) if held.num_rows else np.zeros((0, len(cols)))


def conformal(df: DataFrame, keys: list[str], cols: list[str], reference: Column, calibration: Column) -> DataFrame:
    """keys, p_<score> for each of SCORES and fisher (-2 times the sum of their logarithms) of the rows that are neither reference nor calibration.

    Both samples are bounded and go to every task; the rows themselves don't move. Rows with a null in cols play no part.
    Without two reference rows and one calibration row there is nothing to compare with: ValueError. At least two columns are needed.
    """
    full = df.na.drop(subset=cols)
    a, b = sample(full, cols, reference, keys, REFERENCE), sample(full, cols, calibration & ~reference, keys, CALIBRATION)
    if len(a) < 2 or not len(b):
        raise ValueError("two reference rows and one calibration row are needed")
    shared = df.sparkSession.sparkContext.broadcast(fit(a, b))
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(k + i), dtype=np.float64) for i in range(len(cols))], axis=1)
            p = shared.value.p_values(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(v) for v in p], pa.array(-2 * np.log(p).sum(axis=0))], [*keys, *[f"p_{s}" for s in SCORES], "fisher"])

    rows = full.where(~F.coalesce(reference, F.lit(False)) & ~F.coalesce(calibration, F.lit(False))).select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + [f"p_{s} double" for s in SCORES] + ["fisher double"]
    return rows.mapInArrow(run, ", ".join(fields))


def monitored(scored: DataFrame, key: str, order: list[str], lam: float = 0.2) -> DataFrame:
    """Adds ewma, the moving average of fisher along each key from its mean under no change (2 for each score)."""
    return scan.linear(scored, [key], order, 1 - lam, lam * F.col("fisher"), 2.0 * len(SCORES), "ewma")

"""Vector math: native Column expressions and the numpy kernels used inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_expr(a: Column, b: Column) -> Column:
    """sum(a[i] * b[i]) in double, JVM side (higher-order functions, no UDF)."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_expr(a: Column, b: Column) -> Column:
    """Cosine similarity = 1 - cosine distance.  A zero vector gives null (not NaN, which
    would pass a ``> threshold`` filter, and not a DIVIDE_BY_ZERO error under ANSI)."""
    return F.try_divide(dot_expr(a, b), F.sqrt(dot_expr(a, a)) * F.sqrt(dot_expr(b, b)))


def l2_normalise_expr(a: Column) -> Column:
    n = F.sqrt(dot_expr(a, a))
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def usable(a: Column, dim: int) -> Column:
    """A vector of the declared dimension without null or non-finite components."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~bad, F.lit(False))


def unit_rows(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Stack float arrays into an (n, dim) float64 matrix of unit rows.  Returns (matrix,
    valid); zero rows are not valid (their similarity is null)."""
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64).reshape(len(vectors), dim)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    valid = norms > 0
    m[valid] /= norms[valid][:, None]
    return m, valid


def block_top(e: np.ndarray, e_valid: np.ndarray, q: np.ndarray, q_valid: np.ndarray, id_rank: np.ndarray,
              threshold: float, k: int, max_cells: int = 2_000_000):
    """(query row, candidate row, similarity) of the best ``k`` candidates above the threshold
    for each query: by similarity rounded to six places, then by ``id_rank``.  Exactly k rows at
    most, however many tie.  A chunk's score matrix has at most ``max_cells`` cells."""
    out_q, out_r, out_s = [], [], []
    step = max(1, max_cells // max(1, len(e)))
    for lo in range(0, len(q), step):
        sims = q[lo:lo + step] @ e.T
        sims[:, ~e_valid] = -np.inf
        sims[~q_valid[lo:lo + step]] = -np.inf
        for i, row in enumerate(sims):
            at = np.flatnonzero(row > threshold)
            if len(at) > k:      # the k-th best rounded score, then every candidate at or above it
                r = np.round(row[at], 6)
                at = at[r >= np.partition(r, len(r) - k)[len(r) - k]]
                r = np.round(row[at], 6)
                at = at[np.lexsort((id_rank[at], -r))[:k]]
            out_q.append(np.full(len(at), lo + i))
            out_r.append(at)
            out_s.append(row[at])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)

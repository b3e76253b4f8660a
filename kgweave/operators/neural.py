"""Scorers that no expression can express: contractions and convolutions in Arrow batches.

Parameters are numpy arrays of a fixed size that goes out with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _scored(df: DataFrame, score, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """keys and score(*matrices of columns) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = [np.array(b.column(c).to_pylist(), np.float64) for c in columns]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(score(*x), pa.float64())], [*keys, "score"])

    some = df.select(*keys, *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema if f.name in keys)
    return some.mapInArrow(run, f"{kinds}, score double")


def tucker(df: DataFrame, core: np.ndarray, keys: list[str]) -> DataFrame:
    """Sum of core[i, j, k] h[i] r[j] t[k], of columns hv, r, tv."""
    return _scored(df, lambda h, r, t: np.einsum("ijk,ni,nj,nk->n", core, h, r, t, optimize=True), keys, ("hv", "r", "tv"))


def conv_e(df: DataFrame, filters: np.ndarray, project: np.ndarray, width: int, keys: list[str], norms: tuple | None = None, bias: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Head and relation as stacked images, filters of k x k, a rectifier, a projection, the tail.

    filters: (n, k, k); project: (n * rows * columns of the outputs, size of a vector). norms: batch
    norms of the image, the maps and the projection, each (mean, variance, scale, shift) of its
    channels as they were learned; bias: of the projection, and a number added to every score.
    """
    image_norm, map_norm, out_norm = norms or (None, None, None)
    added, shift = bias if bias is not None else (0.0, 0.0)

    def normed(x: np.ndarray, norm, shape: tuple[int, ...]) -> np.ndarray:
        if norm is None:
            return x
        mean, variance, scale, offset = (np.reshape(v, shape) for v in norm)
        return (x - mean) / np.sqrt(variance + 1e-5) * scale + offset

    def score(h: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
        image = normed(np.concatenate([x.reshape(len(x), -1, width) for x in (h, r)], 1), image_norm, (1, 1, 1))
        k = filters.shape[1]
        patches = np.lib.stride_tricks.sliding_window_view(image, (k, k), (1, 2))
        maps = np.maximum(normed(np.einsum("nyxij,fij->nfyx", patches, filters), map_norm, (1, -1, 1, 1)), 0)
        out = np.maximum(normed(maps.reshape(len(h), -1) @ project + added, out_norm, (1, -1)), 0)
        return np.einsum("nd,nd->n", out, t) + shift

    return _scored(df, score, keys, ("hv", "r", "tv"))


def mlp_bridge(df: DataFrame, hidden: np.ndarray, bias: np.ndarray, out: np.ndarray, keys: list[str]) -> DataFrame:
    """Two scores (proof, kge) through one hidden layer: (2, h), (h), (h)."""
    return _scored(df, lambda p, k: np.maximum(np.stack([p, k], 1) @ hidden + bias, 0) @ out, keys, ("proof", "kge"))

"""Links found in a block of compared rows."""

from __future__ import annotations

import numpy as np


def spanning_forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each linked id with the smallest id of its component within the block, from links
    ``hits`` of rows ``left`` with columns ``right``."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(hits, b, top).min(1, initial=top))
        b2 = np.minimum(b, np.where(hits, a2[:, None], top).min(0, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    used = np.concatenate([hits.any(1), hits.any(0)])
    return np.unique(np.stack([np.concatenate([left, right])[used],
                               np.concatenate([a, b])[used]], axis=1), axis=0)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Rows (node, least node of its component) of all nodes but the least ones, from links of ``a``
    with ``b``, nodes being numbers below ``n``."""
    least = np.arange(n)
    while True:
        u, v = least[a], least[b]
        apart = u != v
        if not apart.any():
            break
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (least[least] != least).any():
            least = least[least]
    node = np.flatnonzero(least != np.arange(n))
    return np.stack([node, least[node]], axis=1)

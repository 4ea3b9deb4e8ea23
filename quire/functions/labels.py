"""Component labels in numpy, for graphs that fit in one batch or task."""

from __future__ import annotations

import numpy as np


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes, for edges between ``u`` and ``v``."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label

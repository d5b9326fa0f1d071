"""Linear equations whose matrix is only given by its products with vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def conjugate_gradients(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """The solution of ``H x = b`` for a symmetric ``H`` without negative curvature, up to a residual of length ``tolerance``.

    After ``most`` products, or where ``H`` has no curvature along the next direction, what is found so far is returned.
    """
    x = np.zeros_like(b)
    left = b.copy()
    along, size = left.copy(), left @ left
    for _ in range(most):
        if math.sqrt(size) <= tolerance:
            break
        image = product(along)
        curvature = along @ image
        if curvature <= 0:
            break
        far = size / curvature
        x, left = x + far * along, left - far * image
        before, size = size, left @ left
        along = left + size / before * along
    return x

"""Points that a classifier can learn."""

import numpy as np


def blob_arrays(rows=200, dims=4, gap=3.0, seed=7):
    """Two Gaussian clouds with an imbalanced label."""
    rng = np.random.default_rng(seed)
    labels = (np.arange(rows) % 4 == 0).astype(int)
    points = rng.normal(size=(rows, dims)) + labels[:, None] * gap
    return points, labels

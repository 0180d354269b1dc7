"""A stand-in for an encoder; in a module of its own, so that workers load nothing else."""

from __future__ import annotations

import numpy as np


def letter_counts(texts: list[str]) -> np.ndarray:
    """How long a text is, and how often it has a, e and a space."""
    return np.array([(len(x), x.count("a"), x.count("e"), x.count(" ")) for x in texts], float).reshape(-1, 4)

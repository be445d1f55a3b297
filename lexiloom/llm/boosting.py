"""Gradient-boosted trees of depth two for logistic loss, fitted from histograms of features within 0 and 1.

Cuts are the multiples of 1 / ``GRID``, whatever the data. A fit needs nothing but sums of gradients and
curvatures by feature and bin, so whoever holds the rows may add them up in any number of parts. The sums are
whole numbers of ``UNIT`` and scores multiples of ``STEP``: the order in which parts are added changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GRID = 80
UNIT, STEP = 2.0**-24, 2.0**-20


def binned(x: np.ndarray) -> np.ndarray:
    """How many cuts lie below each feature: bytes of the shape of ``x``."""
    return np.ceil(np.clip(x, 0, 1) * GRID).astype(np.uint8)


def _rounded(value: float) -> float:
    return float(np.round(value / STEP) * STEP)


class Boosted:
    """Sum of small trees; each tree splits twice, so it has at most four leaves."""

    def __init__(self, trees, base):
        self.trees, self.base = trees, base

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Logits of rows by their bins; a row of ``bins`` is a feature."""
        out = np.full(bins.shape[1], self.base)
        for (f, t), ((fl, tl), (fr, tr)), leaves in self.trees:
            right = bins[f] > t
            second = np.where(right, bins[fr] > tr, bins[fl] > tl)
            out += np.asarray(leaves)[2 * right + second]
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scores(np.ascontiguousarray(binned(x).T))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(score):
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def histogram(model: Boosted, top, bins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums [side of ``top``, feature, bin, gradient or curvature] in ``UNIT``; all rows are on side 0 without ``top``."""
    p = sigmoid(model.scores(bins))
    weights = [np.round(w / UNIT) for w in (y - p, p * (1 - p))]
    side = (bins[top[0]] > top[1]).astype(np.int64) * (GRID + 1) if top else 0
    return np.stack([
        np.stack([np.bincount(side + b.astype(np.int64), w, 2 * (GRID + 1)) for w in weights], axis=-1).reshape(2, GRID + 1, 2) for b in bins
    ], axis=1).astype(np.int64)


def _best(sums: np.ndarray, penalty=1.0):
    """The (feature, cut) with the greatest gain in second-order loss, (0, GRID) for none, and [gradient, curvature] of both sides."""
    left = np.cumsum(sums, axis=1) * UNIT
    whole = left[:, -1:]
    right = whole - left
    gain = sum(part[..., 0] ** 2 / (part[..., 1] + penalty) for part in (left, right)) - whole[..., 0] ** 2 / (whole[..., 1] + penalty)
    f, t = np.unravel_index(np.argmax(gain), gain.shape)
    f, t = (int(f), int(t)) if gain[f, t] > 1e-9 else (0, GRID)
    return (f, t), (left[f, t], right[f, t])


def boost(sums: Callable[[Boosted, tuple[int, int] | None], np.ndarray], rounds: int = 24, rate: float = 0.3) -> Boosted | None:
    """Fits ``rounds`` trees to labels 0 and 1; None without rows.

    ``sums`` gives :func:`histogram` of all rows, for a model and a first split.
    """
    g, h = sums(Boosted([], 0.0), None)[0, 0].sum(axis=0) * UNIT  # of even odds: y - 1/2 and 1/4
    if h == 0:
        return None
    share = (g + 2 * h) / (4 * h)
    clipped = np.clip(share, 1e-3, 1 - 1e-3)
    model = Boosted([], _rounded(np.log(clipped / (1 - clipped))))
    for _ in range(rounds if 0 < share < 1 else 0):
        top, _ = _best(sums(model, None)[0])
        below, leaves = [], []
        for side in sums(model, top):
            split, parts = _best(side)
            below.append(split)
            leaves += [_rounded(rate * g / (h + 1.0)) for g, h in parts]
        model.trees.append((top, tuple(below), leaves))
    return model

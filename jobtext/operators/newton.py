"""Newton steps by conjugate gradients, for objectives whose Hessian is known by its products alone.

A step solves H p = -g for several groups of weights at a time, rows of one
array that share no curvature: a product serves all of them, and each group
stops by itself. A product is a pass over the data, so the system is
preconditioned by what earlier passes told: a blend of the Hessian's diagonal and
the identity, corrected as in L-BFGS by pairs (p, H p) out of the step before.
The pairs change how many products a step takes, not what it solves; where the
Hessian changes much from step to step, a search does better without them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A step's system is solved to this share of the gradient, if nothing else is said, or by so many products.
FORCING, MAX_PRODUCTS = 0.1, 200
#: Share of the Hessian's diagonal in the preconditioner.
BLEND = 0.02
#: Pairs of the step before that are kept, and their bytes at most.
PAIRS, PAIR_BYTES = 30, 128 << 20


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)[:, None]


class Newton:
    """The steps of one search; the pairs of the last are kept for the next."""

    def __init__(self, forcing: float | None = None, keep: int = PAIRS) -> None:
        self.forcing, self.keep = FORCING if forcing is None else forcing, keep
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def step(self, products: Callable[[np.ndarray, np.ndarray], np.ndarray], grad: np.ndarray, diagonal: np.ndarray, enough: float = 0.0) -> np.ndarray:
        """A step for each group (a row of ``grad``), none where the gradient is
        zero. ``products(v, which)`` gives the Hessian of each group of ``which``
        times its row of ``v``. A group is done, too, when no entry of the gradient
        that its step leaves is beyond ``enough``."""
        scale = 1.0 + BLEND * (diagonal - 1.0)
        step, rest = np.zeros_like(grad), -grad
        limit = self.forcing**2 * _dots(rest, rest)
        near = self._solve(rest, scale)
        way, size = near.copy(), _dots(rest, near)
        most = min(self.keep, PAIR_BYTES // (2 * grad.nbytes))
        found, every = [], 1
        for k in range(MAX_PRODUCTS):
            which = np.flatnonzero((_dots(rest, rest) > limit)[:, 0] & (np.abs(rest).max(axis=1) > enough))
            if not len(which):
                break
            bent = np.zeros_like(grad)
            bent[which] = products(way[which], which)
            curve = _dots(way, bent)
            some = curve > 0
            if not some.any():
                break
            rho = np.divide(1.0, curve, out=np.zeros_like(curve), where=some)
            step += size * rho * way
            rest -= size * rho * bent
            if most and k % every == 0:
                found.append((way, bent, rho))
                if len(found) > 2 * most:
                    found, every = found[::2], 2 * every
            near = self._solve(rest, scale)
            new = _dots(rest, near)
            way = near + np.divide(new, size, out=np.zeros_like(new), where=size > 0) * way
            size = new
        if len(found) > most:
            found = [found[i] for i in np.linspace(0, len(found) - 1, most).round().astype(int)]
        self.pairs = found
        return step

    def _solve(self, rest: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """The preconditioner's inverse times ``rest``: the two loops of L-BFGS. A pair with rho zero says nothing of its group."""
        out, by, size = rest.copy(), [], np.ones((len(rest), 1))
        for way, bent, rho in reversed(self.pairs):
            by.append(rho * _dots(way, out))
            out -= by[-1] * bent
        if self.pairs:
            _, bent, rho = self.pairs[-1]
            size = np.divide(1.0, rho * _dots(bent, bent / scale), out=size, where=rho > 0)
        out = size * out / scale
        for way, bent, rho in self.pairs:
            out += (by.pop() - rho * _dots(bent, out)) * way
        return out

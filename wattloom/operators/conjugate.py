"""Block conjugate gradients, step by step: solves (K + ridge) w = goal for all targets at once.

K is never seen. Whoever calls gives a step K times ``ask``, and the step says what to ask next. All targets share one
search space. It starts from the targets and from further columns ``beside`` them, which cost little where a step is a pass
over much data, and grows by as many dimensions a step, so a system of some hundred unknowns takes a few steps. If K +
ridge is singular, targets and columns must be in its range; what is found then is the solution of least norm.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, fields

import numpy as np

#: Directions shorter than this share of the longest one are rounding errors; a restart finds what they may have held.
RANK = 1e-14


def _factored(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of the columns and the factor that turns it back into them."""
    left, size, right = np.linalg.svd(part, full_matrices=False)
    kept = size > RANK * size.max(initial=0)
    return left[:, kept], size[kept, None] * right[kept]


@dataclass
class Descent:
    """State of the solver. ``found``: solution so far; ``ask``: what to multiply next; ``phase``: start, run, check or done."""

    goal: np.ndarray
    beside: np.ndarray
    ridge: np.ndarray
    found: np.ndarray
    ask: np.ndarray
    phase: np.ndarray
    error: np.ndarray
    weights: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, goal: np.ndarray, ridge: float, tolerance: float, beside: np.ndarray | None = None) -> Descent:
        made = cls(goal, np.zeros((len(goal), 0)) if beside is None else beside, np.array(ridge), np.zeros_like(goal), goal, np.array("check"), np.array(np.inf), *[np.zeros((0, 0))] * 2)
        made._start(goal, tolerance)
        return made

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, blob: bytes) -> Descent:
        with np.load(io.BytesIO(blob)) as held:
            return cls(**{f.name: held[f.name] for f in fields(cls)})

    @property
    def done(self) -> bool:
        return str(self.phase) == "done"

    def _lengths(self, part: np.ndarray) -> float:
        """Largest length of a target's column, as a share of its goal."""
        scale = np.sqrt((self.goal**2).sum(axis=0))
        return float((np.sqrt((part**2).sum(axis=0)) / np.where(scale > 0, scale, 1)).max(initial=0))

    def _start(self, residual: np.ndarray, tolerance: float) -> None:
        before, self.error = float(self.error), np.array(self._lengths(residual))
        if self.error <= tolerance or self.error > 0.5 * before:  # good, or as good as rounding lets it be
            self.phase, self.ask = np.array("done"), residual[:, :0]
            return
        wide = np.hstack([residual, self.beside])
        size = np.sqrt((wide**2).sum(axis=0))
        size[size == 0] = 1
        self.near, factor = _factored(wide / size)
        self.weights = factor[:, :residual.shape[1]] * size[:residual.shape[1]]
        self.phase, self.ask = np.array("run"), self.near

    def step(self, product: np.ndarray, tolerance: float) -> None:
        """Go on with ``product`` = K times ``ask``."""
        if str(self.phase) == "check":  # the recurrence drifts from the true residual: start again from that
            self._start(self.goal - product - self.ridge * self.found, tolerance)
            return
        along = product + self.ridge * self.ask
        values, vectors = np.linalg.eigh(self.ask.T @ along)
        kept = values > RANK * max(values.max(initial=0), 0)
        inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
        self.found = self.found + self.ask @ (inverse @ self.weights)
        self.near, factor = _factored(self.near - along @ inverse)
        self.weights = factor @ self.weights
        left = self._lengths(self.weights)
        if left <= max(tolerance, 1e-7 * float(self.error)) or not len(factor):
            self.phase, self.ask = np.array("check"), self.found
        else:
            self.ask = self.near + self.ask @ factor.T

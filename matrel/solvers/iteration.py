"""Convergence control of iterative solvers."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

log = logging.getLogger(__name__)


@dataclass
class Iteration:
    """Stops when the residual is at most ``rtol * norm0`` or ``atol``, or after ``max_iter`` steps (error 1).

    ``norm0`` is the norm given at the start (commonly that of the right side), not the first residual.
    """

    norm0: float
    max_iter: int = 1000
    rtol: float = 1e-10
    atol: float = 0.0
    i: int = 0
    resid: float = math.inf
    error: int = 0
    message: str = ""
    history: list[float] = field(default_factory=list)

    def converged(self, resid: float | None = None) -> bool:
        r = self.resid if resid is None else resid
        return r <= self.rtol * self.norm0 or r <= self.atol

    def finished(self, resid: float) -> bool:
        self.resid = abs(resid)
        self.history.append(self.resid)
        self.report()
        if self.converged():
            self.error = 0
            return True
        if self.i >= self.max_iter:
            self.error = 1
            return True
        return False

    def step(self) -> None:
        self.i += 1

    def fail(self, code: int, message: str = "") -> int:
        self.error, self.message = code, message
        return code

    def report(self) -> None:
        """Nothing; the noisy kinds log."""


@dataclass
class CyclicIteration(Iteration):
    """Logs every ``cycle`` steps."""

    cycle: int = 100

    def report(self) -> None:
        if self.i % self.cycle == 0:
            log.info("iteration %d: resid %g", self.i, self.resid)


@dataclass
class NoisyIteration(Iteration):
    """Logs every step."""

    def report(self) -> None:
        log.info("iteration %d: resid %g", self.i, self.resid)

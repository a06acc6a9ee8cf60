"""The clock of a replay: position and controls."""

from __future__ import annotations

import time
from collections.abc import Callable


class ReplayClock:
    """Position within [0, duration], advancing with a clock times ``speed`` while it plays."""

    def __init__(self, duration_ms: int, speed: float = 1.0, start_ms: int = 0, clock: Callable[[], float] = time.monotonic):
        if not 0.1 <= speed <= 100:
            raise ValueError("speed is between 0.1 and 100")
        if not 0 <= start_ms <= duration_ms:
            raise ValueError("the start lies outside the timeline")
        self.duration_ms, self.speed, self._clock = duration_ms, speed, clock
        self._set(start_ms, start_ms < duration_ms)

    def _set(self, at_ms: float, playing: bool) -> None:
        self._since, self._from, self._playing = self._clock(), at_ms, playing

    @property
    def position_ms(self) -> int:
        run = (self._clock() - self._since) * 1000 * self.speed if self._playing else 0
        return min(self.duration_ms, max(0, round(self._from + run)))

    @property
    def status(self) -> str:
        return "complete" if self.position_ms >= self.duration_ms else "playing" if self._playing else "paused"

    def control(self, action: str, at_ms: int | None = None) -> None:
        now = self.position_ms
        if action == "pause":
            self._set(now, False)
        elif action == "resume":
            self._set(now, now < self.duration_ms)
        elif action == "restart":
            self._set(0, self.duration_ms > 0)
        elif action == "seek":
            if at_ms is None or not 0 <= at_ms <= self.duration_ms:
                raise ValueError("seek needs a time inside the timeline")
            self._set(at_ms, self._playing and at_ms < self.duration_ms)
        else:
            raise ValueError(f"unknown action: {action}")

"""Parameters of the tick pipeline; every operator takes what it needs of them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

#: Windows of each factor, in ticks of three seconds where the name ends in t, in minutes of 20 ticks where it ends in m.
TICKS_PER_MINUTE = 20


@dataclass(frozen=True)
class Params:
    freq: str = "3 seconds"
    sessions: tuple[tuple[str, str], ...] = (("09:30:00", "11:30:00"), ("13:00:00", "14:57:00"))
    horizons: tuple[int, ...] = (100, 200, 300)
    gap_threshold: float = 60.0
    am_end: str = "11:29:57"
    pm_start: str = "13:00:00"
    quantiles: int = 5
    deciles: int = 10
    ic_threshold: float = 0.02
    by: tuple[str, ...] = ("date", "security_id")
    order: str = "tick_idx"

"""Settings of a forecasting run."""

from __future__ import annotations

import re
from dataclasses import dataclass

SEASONS = ("summer", "winter")


@dataclass(frozen=True)
class ForecastConf:
    """Season, window lengths and split of one run; immutable, so runs cannot affect each other."""

    season: str = "summer"
    prev_times: int = 192
    next_times: int = 24
    test_ratio: float = 0.2
    train_sample_ratio: float = 1.0
    summer_months: tuple[int, ...] = (4, 5, 6, 7, 8, 9)
    time_flag_var: str = "time"
    time_var_format: str = ".+_d[1-7]_t_$"
    value_var_format: str = "^h[0-9]+"

    def __post_init__(self) -> None:
        if self.season not in SEASONS:
            raise ValueError(f"season must be one of {SEASONS}, got {self.season!r}")
        if self.prev_times < 1 or self.next_times < 1:
            raise ValueError("prev_times and next_times must be positive")
        if not 0 < self.test_ratio < 1:
            raise ValueError("test_ratio must lie between 0 and 1")
        if self.train_sample_ratio <= 0:
            raise ValueError("train_sample_ratio must be positive")
        re.compile(self.time_var_format)
        re.compile(self.value_var_format)

"""Column families by name pattern, for wide tables at the edge of the engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from wattloom.conf import ForecastConf


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names matching the pattern from their start, in table order."""
    return [c for c in df.columns if re.match(pattern, c)]


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def use_columns(df: DataFrame, conf: ForecastConf = ForecastConf()) -> list[str]:
    """Time variables, then meter columns, each name once."""
    names = columns_like(df, conf.time_var_format) + columns_like(df, conf.value_var_format)
    return list(dict.fromkeys(names))


def column_positions(df: DataFrame, names: list[str]) -> list[int]:
    wanted = set(names)
    return [i for i, c in enumerate(df.columns) if c in wanted]

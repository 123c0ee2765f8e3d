"""Load-series analytics as Spark jobs over long tables."""

from wattloom.conf import ForecastConf

__all__ = ["ForecastConf"]

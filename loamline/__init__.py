"""loamline: time-series, climate-panel and registry analytics as Spark DataFrame operators."""

from loamline.session import build_session

__all__ = ["build_session"]

"""Panel time-series analytics on Spark DataFrames.

Every operator takes and returns DataFrames. A panel is one long table keyed by
(symbol, date); "date" is a timestamp at midnight.
"""
from tidepanel.core.session import build_session

__all__ = ["build_session"]

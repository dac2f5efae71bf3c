"""Technical-debt analytics for source code, written as Spark DataFrame jobs."""

from debtscope.session import build_session

__all__ = ["build_session"]

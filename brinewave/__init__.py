"""Ocean-observation analytics as Spark DataFrame operators."""

from brinewave.session import build_session, prepare

__all__ = ["build_session", "prepare"]

"""The queries over the test tables, and their SQL."""

from . import answers, catalogue, reports

__all__ = ["answers", "catalogue", "reports"]

"""The registered queries of the library's own operators, and their SQL."""

from quirework.plans import more, services, styles  # noqa: F401  (they register their queries)
from quirework.plans.library import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

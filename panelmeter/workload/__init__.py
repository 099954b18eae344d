from . import adaptive_queries, fit_queries, panel_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401

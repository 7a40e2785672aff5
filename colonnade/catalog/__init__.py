from colonnade.catalog import causality, charting, cleaning, learning, profiling, regression, selection, storing, surviving, temporal, testing  # noqa: F401
from colonnade.catalog.base import ORACLES, QUERIES  # noqa: F401

"""Runnable queries over the test tables, by family."""

from . import profiling, cleaning, exploration, rules, evaluation, forecasting, storage, modelling  # noqa: F401
from .base import CHECKS, QUERIES  # noqa: F401

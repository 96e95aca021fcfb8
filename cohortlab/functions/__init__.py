"""Column-expression helpers: recodes, text rules, distribution tails, report formatting."""
from . import dist, expr, fmt  # noqa: F401

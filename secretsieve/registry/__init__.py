"""All registered queries; importing the package fills the register."""

from . import dataset, evaluation, relational, rules, scoring, streams, text, trends  # noqa: F401
from .base import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]

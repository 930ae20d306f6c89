"""Registered queries over the star-schema tables, each with its SQL oracle."""

from . import incidence, language, learned, measures, structure, text, theory  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

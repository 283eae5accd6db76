"""All queries of the engine; importing the plans registers them."""

from __future__ import annotations

from tidewright.plans import augmentation, corpus, evaluation, files, records, relational, reports, requests, streams, tokens  # noqa: F401
from tidewright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Importing this package registers every query."""

from corvane.queries import (evaluation, graphs, models, profiles, relations, retrieval, scalars,  # noqa: F401
                             scans, topic_queries)
from corvane.queries.registry import ORACLES, QUERIES  # noqa: F401

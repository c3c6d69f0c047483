"""Importing the query modules fills the registry."""

from loamline.plans import (  # noqa: F401
    q_aggregates, q_features, q_functions, q_joins, q_ledger, q_models, q_quality, q_sources, q_spatial,
    q_streaming, q_windows,
)
from loamline.plans.registry import REGISTRY  # noqa: F401

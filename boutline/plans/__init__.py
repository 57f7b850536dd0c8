"""Registered queries; importing this package fills the registry."""

from boutline.plans import context, evaluation, history, io, modelling, models, ratings, scalars, streams, tables
from boutline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "context", "evaluation", "history", "io", "modelling", "models", "ratings", "scalars", "streams", "tables"]

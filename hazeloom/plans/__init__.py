"""All registered queries; importing the modules fills the registry."""

from . import aggregates, folds, joins, live, ranking, scalars, scans, training, windows
from .registry import REGISTRY

__all__ = ["REGISTRY", "aggregates", "folds", "joins", "live", "ranking", "scalars", "scans", "training", "windows"]
